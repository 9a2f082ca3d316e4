"""Air-quality analytics over particulate-matter readings, as Spark DataFrame jobs.

Every operator takes and returns DataFrames (or Columns); see ``README.md`` for
the table shapes and how the pieces fit together.
"""

from hazemeter.params import DEFAULTS, Params

__all__ = ["DEFAULTS", "Params"]
