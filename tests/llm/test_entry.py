import __spark_entry__
from tidewatch.llm import queries


def test_all_ten_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] == sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert {"op2_secret_scan", "op3_url_filter", "op10_decontamination"} <= set(__spark_entry__.oracle_sql())
