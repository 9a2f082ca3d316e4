"""The two standing questions, and the catalogue of registered queries."""
