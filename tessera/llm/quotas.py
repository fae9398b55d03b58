"""Problem 5: a sample with given two-way category proportions.

Fractional quotas form a table of databases by difficulties.  A first flow sends what every cell needs through what it
holds; what cannot be sent is its shortfall.  Minimums and holdings then bound the cells: quotas are scaled by one factor
between these bounds until they add up to the sample again.  Controlled rounding makes the bounded table integer by
max-flow: every cell becomes its floor or ceiling while row sums, column sums and the total do so too, so that neither a
minimum nor a holding is ever passed.  Each cell takes exactly its quota of distinct questions, the first by a random key.
"""

from __future__ import annotations

from collections import defaultdict, deque
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.prefix import running_sum
from tessera.plans.cluster import cut

PART = 5  # the sample is a fifth of the distinct questions in listed strata
MAX_STRATA = 100_000  # the targets are a stated table; quotas are computed on the driver, a longer table is refused
BUCKETS = 64


def _max_flow(n: int, edges: list[list[int]], s: int, t: int) -> int:
    """Dinic; edges are [from, to, capacity] and keep their residual capacities; edge i's reverse is i ^ 1."""
    out: list[list[int]] = [[] for _ in range(n)]
    for i, (u, _, _) in enumerate(edges):
        out[u].append(i)
    flow = 0
    while True:
        level = [-1] * n
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for i in out[u]:
                v = edges[i][1]
                if edges[i][2] and level[v] < 0:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[t] < 0:
            return flow
        turn = [0] * n
        while True:
            path, u = [], s
            while u != t:
                while turn[u] < len(out[u]):
                    i = out[u][turn[u]]
                    if edges[i][2] and level[edges[i][1]] == level[u] + 1:
                        break
                    turn[u] += 1
                if turn[u] == len(out[u]):
                    if not path:
                        break
                    u = edges[path.pop()][0]
                    turn[u] += 1
                else:
                    path.append(out[u][turn[u]])
                    u = edges[path[-1]][1]
            if u != t:
                break
            push = min(edges[i][2] for i in path)
            for i in path:
                edges[i][2] -= push
                edges[i ^ 1][2] += push
            flow += push


def controlled_rounding(quota: dict[tuple[str, str], Fraction]) -> dict[tuple[str, str], int]:
    """Integers within one of ``quota`` (floor or ceiling) whose row, column and total sums are floors or ceilings as well."""
    rows, cols = sorted({a for a, _ in quota}), sorted({b for _, b in quota})
    number = {("r", a): i for i, a in enumerate(rows)} | {("c", b): len(rows) + i for i, b in enumerate(cols)}
    n = len(number)
    source, sink, top, bottom = n, n + 1, n + 2, n + 3
    edges: list[list[int]] = []
    excess = [0] * (n + 4)

    def arc(u: int, v: int, low: int, high: int) -> int:
        edges.append([u, v, high - low])
        edges.append([v, u, 0])
        excess[v] += low
        excess[u] -= low
        return len(edges) - 2

    floor = lambda x: x.numerator // x.denominator
    ceil = lambda x: -((-x.numerator) // x.denominator)
    span = lambda x: (floor(x), ceil(x))
    cell = {k: arc(number["r", k[0]], number["c", k[1]], *span(q)) for k, q in quota.items()}
    sums: dict[tuple[str, str], Fraction] = defaultdict(Fraction)
    for (a, b), q in quota.items():
        sums["r", a] += q
        sums["c", b] += q
    for a in rows:
        arc(source, number["r", a], *span(sums["r", a]))
    for b in cols:
        arc(number["c", b], sink, *span(sums["c", b]))
    arc(sink, source, *span(sum(quota.values(), Fraction(0))))
    need = 0
    for v in range(n + 2):
        if excess[v] > 0:
            edges += [[top, v, excess[v]], [v, top, 0]]
            need += excess[v]
        elif excess[v] < 0:
            edges += [[v, bottom, -excess[v]], [bottom, v, 0]]
    if _max_flow(n + 4, edges, top, bottom) != need:
        raise AssertionError("a fractional table always has a controlled rounding")
    return {k: floor(quota[k]) + edges[i ^ 1][2] for k, i in cell.items()}


def shortfalls(need: dict[tuple[str, str], int], held: dict[tuple[str, str], int]) -> dict[tuple[str, str], int]:
    """What each cell lacks: the part of its need that a maximum flow from the needs through the holdings cannot send.

    The flow runs row -> cell -> column; the arc into a cell carries its need, the arc out of it what it holds.
    """
    rows, cols, cells = sorted({a for a, _ in need}), sorted({b for _, b in need}), sorted(need)
    number = {x: i for i, x in enumerate([("r", a) for a in rows] + [("c", b) for b in cols] + [("x", k) for k in cells])}
    source, sink = len(number), len(number) + 1
    edges: list[list[int]] = []

    def arc(u: int, v: int, most: int) -> int:
        edges.extend([[u, v, most], [v, u, 0]])
        return len(edges) - 2

    total = sum(need.values())
    for a in rows:
        arc(source, number["r", a], total)
    for b in cols:
        arc(number["c", b], sink, total)
    into = {}
    for a, b in cells:
        into[a, b] = arc(number["r", a], number["x", (a, b)], need[a, b])
        arc(number["x", (a, b)], number["c", b], held.get((a, b), 0))
    _max_flow(len(number) + 2, edges, source, sink)
    return {k: edges[i][2] for k, i in into.items()}


def bounded(quota: dict[tuple[str, str], Fraction], least: dict[tuple[str, str], int], held: dict[tuple[str, str], int]) -> dict[tuple[str, str], Fraction]:
    """Quotas times one factor, each kept between its minimum and what its cell holds, that add up to the old total.

    Where all that is held is less than the total, everything is taken; where the minimums are more, only these.
    A cell without a quota keeps its minimum.
    """
    low = {k: Fraction(min(least[k], held.get(k, 0))) for k in quota}
    high = {k: Fraction(held.get(k, 0)) if quota[k] else low[k] for k in quota}
    total = min(sum(quota.values(), Fraction(0)), sum(high.values(), Fraction(0)))
    if sum(low.values(), Fraction(0)) >= total:
        return low
    # between two breaks the sum is linear in the factor: cells below their low or above their high bound stand still
    marks = sorted([(low[k] / q, 0, k) for k, q in quota.items() if q] + [(high[k] / q, 1, k) for k, q in quota.items() if q])
    still, slope, factor = sum(low.values(), Fraction(0)), Fraction(0), Fraction(0)
    for at, kind, k in marks:
        if slope and still + slope * at >= total:
            break
        if kind == 0:
            still, slope = still - low[k], slope + quota[k]
        else:
            still, slope = still + high[k], slope - quota[k]
    factor = (total - still) / slope if slope else marks[-1][0]
    return {k: min(high[k], max(low[k], factor * q)) for k, q in quota.items()}


def category(c: str):
    return F.lower(F.trim(F.col(c)))


def _strata(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (a, b, question) of the listed strata with the smallest id of each; targets are few and broadcast by Spark."""
    wanted = targets.select(category("db_id").alias("a"), category("difficulty").alias("b")).where("a is not null and b is not null").distinct()
    found = rows.select("id", "question", category("db_id").alias("a"), category("difficulty").alias("b")).where("question is not null")
    return found.join(wanted, ["a", "b"]).groupBy("a", "b", "question").agg(F.min("id").alias("id"))


def plan(rows: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[dict]]:
    """The distinct questions of the listed strata, and per stratum what is wanted, there and taken.

    ``rows``: id, question, db_id, difficulty.  Null questions and unlisted, null or misspelt categories take no part;
    a stratum listed twice adds its shares; an empty table makes every stratum with a minimum fall short.
    """
    strata = cut(_strata(rows, targets))
    listed = (
        targets.groupBy(category("db_id").alias("a"), category("difficulty").alias("b")).agg(F.sum("target_bp").alias("bp"), F.max("min_rows").alias("least"))
        .where("a is not null and b is not null").orderBy("a", "b").limit(MAX_STRATA + 1).collect()
    )
    if len(listed) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    held = {(r["a"], r["b"]): r["n"] for r in strata.groupBy("a", "b").agg(F.count("*").alias("n")).collect()}  # at most one row a stratum
    size = sum(held.values()) // PART
    share = {(r["a"], r["b"]): Fraction(size * (r["bp"] or 0), 10000) for r in listed}
    least = {(r["a"], r["b"]): int(r["least"] or 0) for r in listed}
    need = {k: max(least[k], q.numerator // q.denominator) for k, q in share.items()}
    missing = shortfalls(need, held)
    quota = controlled_rounding(bounded(share, least, held))
    out = []
    for r in listed:
        k = (r["a"], r["b"])
        out.append({"a": k[0], "b": k[1], "target_bp": int(r["bp"] or 0), "needed": need[k], "available": held.get(k, 0), "quota": quota[k], "taken": quota[k], "missing": missing[k]})
    return strata, out


REPORT = "a string, b string, target_bp long, needed long, available long, quota long, taken long, missing long"


def report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    _, strata = plan(rows, targets)
    return rows.sparkSession.createDataFrame([tuple(x.values()) for x in strata], REPORT).withColumnsRenamed({"a": "db_id", "b": "difficulty"})


def sample(rows: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """(id, question, db_id, difficulty): exactly the quota of each stratum, by random key; a hot stratum is ranked in buckets."""
    strata, wanted = plan(rows, targets)
    take = rows.sparkSession.createDataFrame([(x["a"], x["b"], x["taken"]) for x in wanted], "a string, b string, taken long")
    keyed = strata.withColumn("key", F.xxhash64(F.lit(seed), "a", "b", "question")).withColumn("one", F.lit(1))
    ranked = running_sum(keyed, ["a", "b"], "key", "question", "one", BUCKETS)
    return ranked.join(take, ["a", "b"]).where("before < taken").select("id", "question", F.col("a").alias("db_id"), F.col("b").alias("difficulty"))
