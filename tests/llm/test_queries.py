import __spark_entry__ as entry
from tidemark.llm import queries as Q


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert all(callable(q) for q in names.values())
    assert all(isinstance(q, str) for q in entry.oracle_sql().values()) and set(Q.oracle_sql()) <= set(Q.queries())
