"""The spending tree against a plain Python version on rows of its own."""

import random
from decimal import Decimal as D

from fundflow.operators.hierarchy import spending_tree

SCHEMA = ("candidate_id string, inside_disbursements decimal(15,2), outside_support decimal(15,2), "
          "outside_oppose decimal(15,2), candidate struct<candidate_id:string,name:string,state:string,"
          "office:string,district:string,party:string,incumbent_challenge:string>")
RACES = {"P": "Presidential", "S": "Senate", "H": "House"}
LIMIT = 5_000


def feed(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        cid, office = f"K{i:03d}", rng.choice(["P", "S", "H", "H", "X", None])
        money = [None if rng.random() < 0.1 else D(rng.randrange(0, 600_000)) / 100 for _ in range(3)]
        known = None if rng.random() < 0.1 else (cid, rng.choice([None, f"Name {i % 7}"]), "ZZ", office, None,
                                                 rng.choice(["DEM", "REP", "DFL", "GRN", None]), None)
        out.append((cid, *money, known))
    return out


def plain(rows):
    """path -> (value, children paths) of every node."""
    zero, value, parent = D(0), {}, {}

    def add(path, up, amount):
        value[path] = value.get(path, zero) + amount
        parent[path] = up

    add("root", None, zero)
    for race in RACES.values():
        add(f"root/{race}", "root", zero)
        add(f"root/{race}/Others", f"root/{race}", zero)
    for cid, inside, support, oppose, known in rows:
        inside, support, oppose = (x or zero for x in (inside, support, oppose))
        if not known or known[3] not in RACES:
            continue
        race = f"root/{RACES[known[3]]}"
        add(race, "root", inside + support + oppose)
        add("root", None, inside + support + oppose)
        if support + oppose < LIMIT:
            add(f"{race}/Others", race, inside + support + oppose)
            continue
        add(f"{race}/{cid}", race, inside + support + oppose)
        for leaf, amount in (("Inside", inside), ("Outside Support", support), ("Outside Oppose", oppose)):
            add(f"{race}/{cid}/{leaf}", f"{race}/{cid}", amount)
    return value, parent


def test_values_and_shape_against_a_plain_version(spark):
    rows = feed(120, 4)
    got = {r.path: r for r in spending_tree(spark, spark.createDataFrame(rows, SCHEMA), LIMIT).collect()}
    value, parent = plain(rows)
    assert {p: r.value for p, r in got.items()} == value
    assert {p: r.parent for p, r in got.items()} == parent


def test_siblings_are_ranked_by_value_then_name(spark):
    nodes = spending_tree(spark, spark.createDataFrame(feed(200, 5), SCHEMA), LIMIT).collect()
    for up in {r.parent for r in nodes}:
        children = [r for r in nodes if r.parent == up]
        order = sorted(children, key=lambda r: (-r.value, r.name, r.path))
        assert [r.sibling_rank for r in order] == list(range(1, len(children) + 1))


def test_labels_follow_the_candidate(spark):
    rows = [("Q1", D(10), D(9_000), D(0), ("Q1", "Zoe Q", None, "S", None, "DFL", None)),
            ("Q2", D(0), D(0), D(7_000), ("Q2", None, None, "S", None, "REP", None))]
    got = {r.path: r for r in spending_tree(spark, spark.createDataFrame(rows, SCHEMA), LIMIT).collect()}
    one, two = got["root/Senate/Q1"], got["root/Senate/Q2"]
    assert (one.name, one.party, one.color_group, one.value_text) == ("Zoe Q", "DFL", "dem", "$9K")
    assert (two.name, two.party, two.color_group, two.kind) == ("Q2", "REP", "rep", "candidate")
    assert got["root/Senate/Q1/Inside"].breadcrumb == "All Races > Senate > Zoe Q > Direct Campaign Spending"
    assert got["root/Senate/Others"].kind == "others" and got["root/House"].value == 0


def test_empty_feed_has_every_race(spark):
    got = {r.path: r.value for r in spending_tree(spark, spark.createDataFrame([], SCHEMA), LIMIT).collect()}
    assert got == plain([])[0]


def test_sums_beyond_the_column_width(spark):
    top = D("9999999999999.99")
    rows = [(f"W{i}", top, top, top, (f"W{i}", None, None, "H", None, None, None)) for i in range(150)]
    got = {r.path: r.value for r in spending_tree(spark, spark.createDataFrame(rows, SCHEMA), LIMIT).collect()}
    assert got["root"] == top * 450
