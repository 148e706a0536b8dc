from tessera.functions import scalars, settings
from tessera.sources import provenance


def entries(spark, rows):
    return spark.createDataFrame(rows, "part string, name string, digest string")


def test_changes_name_what_differs(spark):
    rows = [("input", f"f{k}", f"d{k}") for k in range(300)] + [("setting", "seed", "a"), ("code", "f0", "x")]
    before = entries(spark, rows)
    again = entries(spark, rows[::-1]).repartition(5)
    assert provenance.signature(before) == provenance.signature(again) and provenance.changes(before, again).count() == 0
    other = [r for r in rows if r[1] != "f7"] + [("input", "new", "n")]
    other = [(p, n, "y" if p == "code" else d) for p, n, d in other]
    after = entries(spark, other)
    assert {tuple(r) for r in provenance.changes(before, after).collect()} == {("input", "f7", "removed"), ("input", "new", "added"), ("code", "f0", "changed")}
    one, two = ({r.part: r.digest for r in provenance.parts(e).collect()} for e in (before, after))
    assert one["setting"] == two["setting"] and one["code"] != two["code"] and one["input"] != two["input"]
    assert provenance.signature(before) != provenance.signature(after)
    none = before.limit(0)
    assert provenance.changes(none, none).count() == 0 and provenance.changes(none, before).count() == len(rows)


def test_names_and_digests_do_not_run_into_each_other(spark):
    assert provenance.signature(entries(spark, [("a", "bc", "d")])) != provenance.signature(entries(spark, [("ab", "c", "d")]))
    assert provenance.signature(entries(spark, [("a", "bc", "d")])) != provenance.signature(entries(spark, [("a", "b", "cd")]))


def test_settings_and_code_are_entries(spark):
    run = lambda seed: provenance.settings_and_code(spark, {"seed": seed, "grid": {"b": 1, "a": [2]}}, [scalars.logit, settings])
    names = {(r.part, r.name) for r in run(1).collect()}
    assert names == {("setting", "seed"), ("setting", "grid"), ("code", "tessera.functions.scalars.logit"), ("code", "tessera.functions.settings")}
    assert [tuple(r) for r in provenance.changes(run(1), run(2)).collect()] == [("setting", "seed", "changed")]
