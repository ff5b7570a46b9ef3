import itertools

from claimweave.operators import hubs
from claimweave.operators.linker import CLAIMS, Linker


def brute(sources, targets):
    got = {}
    for (h, s), (k, t, c, e) in itertools.product(sources, targets):
        if h is not None and h == k and s is not None and t is not None:
            cs, es = got.setdefault((s, t), ([], []))
            cs += [] if c is None else [c]
            es += [] if e is None else [e]
    return sorted((s, t, max(c, default=None), min(e, default=None)) for (s, t), (c, e) in got.items())


def frames(spark, sources, targets):
    return spark.createDataFrame(sources, "hub string, source string"), spark.createDataFrame(targets, "hub string, target string, confidence double, evidence string")


def test_pairs_equal_all_products(spark, monkeypatch):
    sources = [(f"h{i % 7}", f"s{i % 23}") for i in range(80)] * 2 + [(None, "s1"), ("h1", None), ("h9", "lone")]
    targets = [(f"h{i % 9}", f"t{i % 31}", None if i % 5 == 0 else i % 11 / 10, None if i % 4 == 0 else f"é{i % 13}:{i}") for i in range(90)]
    targets += [(None, "t1", 1.0, "a"), ("h1", None, 1.0, "a"), ("h1", "bare", None, None), ("h2", "t1", 0.9, "Z"), ("h2", "t1", 0.2, "a")]
    for most, batch in ((500_000, 65_536), (20, 3)):
        monkeypatch.setattr(hubs, "BLOCK_MOST", most)
        monkeypatch.setattr(hubs, "BATCH", batch)
        got = sorted(map(tuple, hubs.pairs(*frames(spark, sources, targets)).collect()))
        assert got == brute(sources, targets)
    assert hubs.pairs(*frames(spark, [], targets)).count() == hubs.pairs(*frames(spark, sources, [])).count() == 0


def repo_claims(n_repos, n_names, lib=False):
    """Every repository provides every name, and every name depends on the next one."""
    claim = lambda r, kind, direction, key, i, **attrs: (f"{r}|{kind}|{direction}|{key}|{i}", r, kind, direction, key, None, "compose.yml", i, attrs, None)
    out = []
    for r in range(n_repos):
        for s in range(n_names):
            out.append(claim(f"r{r}", "svcname", "provides", f"default:n{s}", s, source="compose"))
            out.append(claim(f"r{r}", "svcname", "consumes", f"default:n{(s + 1) % n_names}", s, **{"from": f"n{s}"}))
    if lib:
        out += [claim("r0", "lib", "provides", "pkg:npm/x", 1), claim("r1", "lib", "consumes", "pkg:npm/x", 1), claim("r2", "lib", "consumes", "pkg:npm/x", 1), claim("alone", "lib", "consumes", "pkg:npm/x", 1)]
    return out


def written(spark):
    """Rows that all shuffles have written so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_repositories_are_not_shuffled(spark):
    """Two services of 300 repositories each: all pairs come out, and no shuffle holds them."""
    linker = Linker(spark.createDataFrame(repo_claims(300, 2), CLAIMS))
    linker.found  # noqa: B018
    before = written(spark)
    got = linker.edges().where("type = 'DEPENDS_ON_REPO'").selectExpr("count(*) AS n", "count_if(confidence = 0.96 and status = 'active' and evidence = 'compose.yml:0' and detected_by = 'deps_rollup' and n_rows = 1) AS whole", "bit_xor(xxhash64(source_id, target_id)) AS x").first()
    pairs = spark.range(300).selectExpr("concat('r', id) AS a").crossJoin(spark.range(300).selectExpr("concat('r', id) AS b")).where("a <> b").selectExpr("bit_xor(xxhash64(a, b)) AS x").first()
    assert (got.n, got.whole, got.x) == (300 * 299, 300 * 299, pairs.x)
    assert written(spark) - before < 300 * 299 / 4


def test_pairs_that_libraries_find_too_are_fused(spark):
    got = {(r.source_id, r.target_id): (r.n_rows, r.detected_by, round(r.confidence, 4)) for r in Linker(spark.createDataFrame(repo_claims(3, 2, lib=True), CLAIMS)).edges().where("type = 'DEPENDS_ON_REPO'").collect()}
    both, single = (2, "deps_rollup+library", 0.99), (1, "deps_rollup", 0.96)
    assert got == {("r1", "r0"): both, ("r2", "r0"): both, ("r0", "r1"): single, ("r0", "r2"): single, ("r1", "r2"): single, ("r2", "r1"): single, ("alone", "r0"): (1, "library", 0.9)}
