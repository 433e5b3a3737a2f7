"""What the queries on evidence write for one another."""

from catalog import queries
from riskgraph.sources.sample import SampleTables

FOLDER = "/root/testdata/sf0.001"


def test_evidence_writes_its_own_columns_and_checks_written_cases(spark, monkeypatch):
    """No table of all 192 rounded columns; the check for lost cases reads files instead of computing them again."""
    monkeypatch.setattr(queries, "_FITS", {})
    written, checked = {}, []
    write, check = queries.materialize, queries.evidence.require_evidence

    def writing(df, name):
        written[name] = len(df.columns)
        return write(df, name)

    def checking(df):
        checked.append(df._jdf.queryExecution().executedPlan().toString())
        return check(df)

    monkeypatch.setattr(queries, "materialize", writing)
    monkeypatch.setattr(queries.evidence, "require_evidence", checking)
    found = queries.cases(SampleTables(spark, FOLDER))
    assert found.count() == 147 and max(written.values()) < 20
    assert len(checked) == 1 and "Join" not in checked[0] and "Exchange" not in checked[0]
