"""Trigger text as handlers, and jobs in the background."""

import time

import pytest

from tarnbridge.model import Catalog, Field, Relation
from tarnbridge.operators import changes
from tarnbridge.operators.triggers import TriggerAbort, postgres_trigger, tsql_trigger
from tarnbridge.plans.jobs import Jobs
from tarnbridge.plans.migrate import run_migration
from tarnbridge.sources import MemoryEndpoint, ParquetEndpoint
from tarnbridge.sqltext.expressions import Untranslatable

AUDIT = """CREATE TRIGGER dbo.tr_audit ON dbo.t AFTER INSERT, UPDATE, DELETE AS BEGIN
SET NOCOUNT ON;
IF EXISTS (SELECT 1 FROM inserted) AND NOT EXISTS (SELECT 1 FROM deleted)
  INSERT INTO dbo.audit (k, what, inserted_at) SELECT inserted.k, N'inserted', 'now' FROM inserted
IF EXISTS (SELECT 1 FROM deleted) AND EXISTS (SELECT 1 FROM inserted)
BEGIN
  INSERT INTO dbo.audit (k, what, inserted_at) SELECT i.k, d.v + N'>' + i.v, 'now' FROM inserted i JOIN deleted d ON i.k = d.k
END
IF UPDATE(v) INSERT INTO dbo.changed (k) SELECT k FROM deleted
IF EXISTS (SELECT 1 FROM inserted WHERE v = 'bad') BEGIN ROLLBACK TRANSACTION RAISERROR(N'no bad ones', 16, 1) END
END"""
PG = (
    "CREATE TRIGGER tr AFTER INSERT OR UPDATE OR DELETE ON public.t FOR EACH ROW EXECUTE FUNCTION f()",
    """CREATE FUNCTION f() RETURNS trigger LANGUAGE plpgsql AS $body$ BEGIN
IF TG_OP = 'INSERT' THEN INSERT INTO audit (k, what) VALUES (NEW.k, 'inserted');
ELSIF TG_OP = 'UPDATE' THEN
  INSERT INTO audit (k, what) VALUES (NEW.k, OLD.v || '>' || NEW.v);
ELSE INSERT INTO audit (k, what) VALUES (OLD.k, 'gone'); END IF;
IF NEW.v = 'big' THEN INSERT INTO large (k) VALUES (NEW.k); END IF;
RETURN NEW; END $body$""",
)


def table(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")


def batches(spark):
    t, new = table(spark), spark.createDataFrame([(3, "big"), (4, "d")], "k int, v string")
    yield changes.insert_batch("t", new)
    yield changes.update_batch("t", t, spark.createDataFrame([(1, "z")], "k int, v string"), ["k"])
    yield changes.delete_batch("t", t, t.filter("k = 2"), ["k"])


def seen(added, name):
    return sorted(tuple(r)[:2] for r in added[name].collect()) if name in added else []


def test_tsql_trigger_text(spark):
    tr = tsql_trigger(AUDIT, ["k"])
    assert (tr.name, tr.table, tr.handler.events, tr.handler.timing) == ("tr_audit", "t", {"INSERT", "UPDATE", "DELETE"}, "AFTER") and tr.warnings == ["ROLLBACK in the trigger is left out"]
    got = [changes.apply_change(table(spark), b, ["k"], [tr.handler])[1] for b in batches(spark)]
    assert [seen(a, "audit") for a in got] == [[(3, "inserted"), (4, "inserted")], [(1, "a>z")], []]
    assert [seen(a, "changed") for a in got] == [[], [(1,)], []]
    with pytest.raises(TriggerAbort, match="no bad ones"):
        changes.apply_change(table(spark), changes.insert_batch("t", spark.createDataFrame([(9, "bad")], "k int, v string")), ["k"], [tr.handler])


def test_postgres_trigger_text(spark):
    tr = postgres_trigger(*PG, ["k"])
    got = [changes.apply_change(table(spark), b, ["k"], [tr.handler])[1] for b in batches(spark)]
    assert [seen(a, "audit") for a in got] == [[(3, "inserted"), (4, "inserted")], [(1, "a>z")], [(2, "gone")]]
    assert [seen(a, "large") for a in got] == [[(3,)], [], []]


def test_instead_of_and_refused_texts(spark):
    tr = tsql_trigger("CREATE TRIGGER tr ON t INSTEAD OF DELETE AS INSERT INTO kept SELECT k FROM deleted", ["k"])
    after, added = changes.apply_change(table(spark), list(batches(spark))[2], ["k"], [tr.handler])
    assert after.count() == 2 and seen(added, "kept") == [(2,)]
    for body in ("UPDATE u SET a = 1", "EXEC p", "IF 1 = 1 INSERT INTO u SELECT k FROM inserted"):
        with pytest.raises(Untranslatable):
            tsql_trigger(f"CREATE TRIGGER tr ON t AFTER INSERT AS BEGIN {body} END", ["k"])
    with pytest.raises(Untranslatable):
        postgres_trigger("CREATE TRIGGER tr BEFORE INSERT ON t FOR EACH ROW EXECUTE FUNCTION f()", PG[1], ["k"])


def test_changes_nest_to_a_depth(spark):
    t = table(spark)

    def again(batch):
        batch.then(t, changes.insert_batch("t", t), ["k"], [changes.Handler(frozenset({"INSERT"}), again)])

    with pytest.raises(RecursionError):
        changes.apply_change(t, changes.insert_batch("t", t), ["k"], [changes.Handler(frozenset({"INSERT"}), again)])


def test_jobs(spark, tmp_path):
    jobs = Jobs(spark)
    db = Catalog("d", "tsql", [Relation("T", [Field("a", "int")]), Relation("Bad", [Field("nope", "int")])])
    source = MemoryEndpoint(spark, {t: spark.createDataFrame([(1,)], "a int") for t in ("T", "Bad")})
    job = jobs.start("move", lambda j: run_migration(spark, source, ParquetEndpoint(spark, str(tmp_path)), db, progress=j.progress, cancelled=j.stop.is_set))
    job.thread.join(60)
    assert job.status == "failed" and job.percent == 100 and [e[:2] for e in job.errors] == [("table", "Bad")]
    assert jobs.errors(kind="table", text="NOPE").count() == 1 and jobs.errors(job="other").count() == 0
    slow = jobs.start("wait", lambda j: spark.range(2 * 10**10).selectExpr("sum(sqrt(id))").collect())
    with pytest.raises(RuntimeError):
        jobs.start("wait", lambda j: None)
    time.sleep(1)
    jobs.cancel(slow)
    slow.thread.join(20)
    assert slow.status == "cancelled", slow.errors
    assert {r["name"]: r["status"] for r in jobs.frame().collect()} == {"move": "failed", "wait": "cancelled"}
