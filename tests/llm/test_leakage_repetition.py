import random
from collections import defaultdict

from claimweave.llm import leakage, repetition


def brute_leaks(docs, items):
    have = defaultdict(set)
    words = {i: leakage.words_of(p) for i, p in items.items()}
    for i, w in words.items():
        for k in range(len(w) - 5):
            have[tuple(w[k : k + 6])].add(i)
    out = set()
    for d, text in docs.items():
        w = leakage.words_of(text)
        runs = {tuple(w[k : k + 6]) for k in range(len(w) - 5)}
        for i, iw in words.items():
            spans = [(k, tuple(iw[k : k + 6])) for k in range(len(iw) - 5)]
            own = set(range(len(iw))) - {p for k, r in spans if len(have[r]) > 1 for p in range(k, k + 6)}
            cov = {p for k, r in spans if len(have[r]) == 1 and r in runs for p in range(k, k + 6)}
            if own and len(cov & own) * 3 >= len(own):
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    random.seed(3)
    vocab = [f"w{i}" for i in range(9)]
    pick = lambda n: [random.choice(vocab) for _ in range(n)]
    shared = " ".join(pick(8))
    items = {i: f"{shared}. " + " ".join(pick(random.randrange(3, 40))) for i in range(25)} | {99: "short one", 98: shared}
    docs = {d: " ".join(pick(60)) for d in range(60)}
    for d, i in ((100, 1), (101, 2), (102, 3)):
        w = items[i].split()
        docs[d] = "X, " + "--".join(w[: len(w) // 2 + 6]).upper() + " y"
    docs |= {200: None, 201: "", 202: shared}
    df = spark.createDataFrame([(d, t, "q") for d, t in docs.items()], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(i, p) for i, p in items.items()] * 2, "item_id bigint, passage string")
    got = [tuple(r) for r in leakage.leaks(df, it).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks({d: t for d, t in docs.items() if t}, items)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i} eps{i} zeta{i} eta{i}") for i in range(6)]
    it = spark.createDataFrame(items, "item_id bigint, passage string")
    df = spark.createDataFrame([(1, " ".join(p for _, p in items))], "doc_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 80)
    assert sorted(r.item_id for r in leakage.leaks(df, it).collect()) == list(range(6))


def brute_repeated(w):
    seen, hit = set(), set()
    for k in range(len(w) - 9):
        run = tuple(w[k : k + 10])
        if run in seen:
            hit.update(range(k, k + 10))
        seen.add(run)
    return len(hit)


def test_repetition_against_brute_force(spark):
    random.seed(5)
    lists = [[random.choice("abc") for _ in range(random.randrange(0, 120))] for _ in range(60)] + [["a"] * 50, [], ["x"] * 10, ["y"] * 11]
    assert repetition.repeated_words(lists).tolist() == [brute_repeated(w) for w in lists]
    assert repetition.repeated_words([]).tolist() == [] and repetition.repeated_words([["a"]]).tolist() == [0]
    df = spark.createDataFrame([(1, "Ä b1c " * 30, 0), (2, None, 0), (3, "", 0), (4, "one two three", 0), (5, "1 2 3", 0)], "doc_id bigint, text string, share int")
    assert [r.doc_id for r in repetition.repetitive(df).collect()] == [1]
    assert {r.doc_id: r.n_words for r in repetition.repetition(df).collect()} == {1: 90, 2: 0, 3: 0, 4: 3, 5: 0}


def test_line_frequency(spark):
    head = "Common header\nline two\n"
    rows = [(i, head + f"own text {chr(97 + i)}\nmore {chr(97 + i)}", "h") for i in range(8)] + [(50, head, "h"), (51, head, None), (52, None, "h"), (53, "", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, repo_id string")
    out = {r.doc_id: (r.n_lines, r.n_common, r.rejected) for r in repetition.line_frequency(df, most_docs=4).collect()}
    assert out[0] == (4, 2, False) and out[50] == (2, 2, True) and out[51] == (2, 0, False) and 52 not in out
