from tessaly.llm import registry


def test_oracles_are_sql_of_known_queries():
    assert all(isinstance(sql, str) and "SELECT" in sql for sql in registry.ORACLES.values())
    assert set(registry.ORACLES) <= set(registry.QUERIES)
