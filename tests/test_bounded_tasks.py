"""What one task holds of cells and of windows does not follow from how the input is cut, nor from a fixed number of tasks."""

from hazemeter.operators import windows
from hazemeter.operators.slices import slice_cells
from hazemeter.plans import fixtures as fx
from hazemeter.plans import standing as st


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_readings_are_dealt_before_cells_are_summed(spark, sf_dir):
    readings = fx.readings(spark, sf_dir, wide=True).coalesce(1)
    cells = slice_cells(readings)
    summed = plan(cells).index("partial_count")
    assert "REPARTITION_BY_COL" in plan(cells)[summed:]
    assert cells.agg({"n": "sum"}).first()[0] == readings.count()


def test_many_rows_are_more_tasks(spark, sf_dir, monkeypatch):
    base = st.timely(fx.readings(spark, sf_dir))
    few = base.at_watermark()
    monkeypatch.setattr(windows, "TASK_ROWS", 50)
    many = base.at_watermark()
    assert "REPARTITION_BY_NUM" in plan(many) and "REPARTITION_BY_NUM" not in plan(few)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
