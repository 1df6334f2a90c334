"""Work plans: layers of groups against a queue, and the columns of a small corpus."""

import random
from collections import defaultdict, deque

import pytest

from quillon.operators import work_plan as P

FUNCTIONS = "name string, file_path string, line_number int, is_stub boolean, docstring string, param_types string, return_type string"
EDGES = "caller string, callee string, caller_file string, resolved boolean"


def queue_layers(names, needs):
    """Layers by a queue that releases a name once all that it needs is out; -1 for the rest."""
    left = {n: len({b for a, b in needs if a == n}) for n in names}
    users, layer = defaultdict(set), {}
    for a, b in needs:
        users[b].add(a)
    ready = deque((n, 1) for n, k in left.items() if k == 0)
    while ready:
        n, k = ready.popleft()
        layer[n] = k
        for a in users[n]:
            left[a] -= 1
            if left[a] == 0:
                ready.append((a, k + 1))
    return {n: layer.get(n, -1) for n in names}


@pytest.mark.parametrize("one_task", (0, 200_000))
def test_layers_of_groups_equal_a_queue(spark, monkeypatch, one_task):
    monkeypatch.setattr("quillon.operators.graph.ONE_TASK", one_task)
    rng = random.Random(3)
    members = sorted({(f"g{rng.randrange(3)}", f"n{rng.randrange(25)}") for _ in range(60)})
    needs = {(f"n{a}", f"n{b}") for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(45)) if a > b} | {("n20", "n20"), ("n3", "n4"), ("n4", "n3"), ("n9", "out")}
    got = {(r["feature"], r["name"]): r["wave"] for r in P.grouped_waves(spark.createDataFrame(members, "feature string, name string"), spark.createDataFrame(sorted(needs), "caller string, callee string")).collect()}
    want = {}
    for group in {g for g, _ in members}:
        names = {n for g, n in members if g == group}
        want |= {(group, n): k for n, k in queue_layers(names, {(a, b) for a, b in needs if a in names and b in names}).items()}
    assert got == want and -1 in want.values() and max(want.values()) > 2


def corpus(spark):
    functions = [
        ("resolve_combat", "world/combat.py", 5, True, " Resolve a combat round. ", "attacker:dict,target:dict", "dict"),
        ("apply_damage", "world/combat.py", 20, True, None, "", None),
        ("choose_action", "world/ai.py", 3, True, "Picks one of the QuestRegistry.", "state:State", "str"),
        ("walk", "world/ai.py", 9, True, "Moves by the WorldEngine.", "state:State", ""),
        ("again", "world/ai.py", 12, True, "", None, None),
        ("roll_dice", "engine/rules.py", 1, False, None, "sides:int", "int"),
        ("Rules.check_hit", "engine/rules.py", 9, False, None, "", "bool"),
        ("lonely", "engine/rules.py", 30, True, None, "", "int"),
        ("run_game", "main.py", 1, False, None, "", None),
        (None, "world/ai.py", 1, True, None, None, None), ("nowhere", None, 1, True, None, None, None)]
    edges = [("run_game", "resolve_combat", "main.py", True), ("run_game", "resolve_combat", "main.py", True), ("run_game", "choose_action", "main.py", True), ("resolve_combat", "apply_damage", "world/combat.py", True),
             ("resolve_combat", "lonely", "world/combat.py", True), ("lonely", "resolve_combat", "engine/rules.py", True), ("again", "again", "world/ai.py", True),
             ("resolve_combat", "missing_helper", "world/combat.py", False), ("resolve_combat", "missing_helper", "world/combat.py", False), ("resolve_combat", "check_hit", "world/combat.py", False), ("resolve_combat", "print", "world/combat.py", False),
             ("resolve_combat", "os.path", "world/combat.py", False), ("choose_action", "elsewhere", "engine/rules.py", False), ("walk", None, "world/ai.py", False)]
    return spark.createDataFrame(functions, FUNCTIONS), spark.createDataFrame(edges, EDGES), spark.createDataFrame([("World", None), ("State", None), ("dict", None)], "name string, base_class string")


def test_plan_of_a_small_corpus(spark):
    rows = {r["name"]: r for r in P.feature_work_plan(*corpus(spark)).collect()}
    assert set(rows) == {"resolve_combat", "apply_damage", "choose_action", "walk", "again", "lonely"}
    fight, hurt, pick, walk, again, lonely = (rows[n] for n in ("resolve_combat", "apply_damage", "choose_action", "walk", "again", "lonely"))
    # Only resolve_combat lacks a function: check_hit is one behind a dot, print is built in, os.path is dotted, the call in engine/ is not world's.
    assert (fight["axis"], fight["needs"], fight["calls_in"], fight["called_by"]) == ("[external]", "missing_helper", 3, "lonely,run_game")
    assert [(r["axis"], r["needs"]) for r in (hurt, pick, walk, again)] == [("world", "")] * 4 and (lonely["feature"], lonely["axis"]) == ("engine", "engine")
    assert (fight["axis_score"], pick["axis_score"], fight["axis_rank"], pick["axis_rank"]) == (4, 7, 2, 1)
    # The cycle between lonely and resolve_combat runs over two features and is cut; again needs itself.
    assert (fight["wave"], hurt["wave"], again["wave"], lonely["wave"]) == (2, 1, -1, 1)
    assert [r["place"] for r in (hurt, pick, walk, again)] == [1, 2, 3, 4]
    assert (fight["signature"], fight["contract"]) == ("(attacker: dict, target: dict) -> dict", "Resolve a combat round.")
    assert (hurt["signature"], hurt["contract"]) == ("() -> [infer: return type unknown]", "[infer: intent from name 'apply_damage']")
    assert (again["signature"], again["contract"]) == ("(?) -> [infer: return type unknown]", "[infer: intent from name 'again']")
    assert (hurt["readiness"], pick["readiness"], again["readiness"]) == ("READY", "READY", "BLOCKED")
    cut = P.feature_work_plan(*corpus(spark), top_axes=1)
    assert "resolve_combat" not in {r["name"] for r in cut.collect()}


def test_concepts_without_a_hold(spark):
    f, _, classes = corpus(spark)
    stubs = spark.createDataFrame([("w", "a", "Uses the QuestRegistry.", "state:State"), ("w", "b", "Moves by the WorldEngine.", "state:State,n:int"), ("w", "c", "plain", ""), ("w", "d", None, None), ("w", "e", "Moves by the WorldEngine.", "")],
                                  "feature string, name string, doc string, params string")
    more = f.unionByName(spark.createDataFrame([("make", "m.py", 1, False, None, "n:int", "Optional[MyWorld]")], FUNCTIONS))
    got = {r["name"]: (r["ghosts"], r["bridges"]) for r in P.groundings(more, classes, stubs).collect()}
    assert got == {"a": (["QuestRegistry"], None), "b": (None, ["state -> World"])}


def test_no_stubs_and_no_rows(spark):
    f, e, classes = corpus(spark)
    assert P.feature_work_plan(f.filter("NOT is_stub"), e, classes).count() == 0
    assert P.feature_work_plan(f.limit(0), e.limit(0), classes.limit(0)).count() == 0
