import random
from itertools import combinations

from pyspark.sql import functions as F

from checkup.llm import stages
from checkup.llm.line_dedup import edits_within, line_rows, probe_shifts, verify, without_repeats
from checkup.llm.queries import QUERIES
from tests.llm.helpers import docs_of, edit_distance, smallest_reachable


def edited(rnd, line, n):
    s = list(line)
    for _ in range(n):
        kind, at = rnd.randrange(3), rnd.randrange(len(s))
        if kind == 0:
            s[at] = rnd.choice("xyz")
        elif kind == 1:
            s.insert(at, rnd.choice("xyzé"))
        else:
            del s[at]
    return "".join(s)


def sample(seed=4):
    rnd = random.Random(seed)
    bases = ["".join(rnd.choice("abcdefgh ij") for _ in range(rnd.randrange(20, 40))).strip().ljust(22, "q") for _ in range(14)]
    docs = []
    for _ in range(18):
        lines = [edited(rnd, rnd.choice(bases), rnd.randrange(5)) for _ in range(rnd.randrange(1, 6))]
        docs.append("\n".join(lines + ["short"]))
    return docs + [None, "", "\n\n", docs[0], "only short\nlines"]


def test_classes_equal_brute_force(spark):
    texts, k = sample(), 2
    first, occ = {}, []
    for d, t in enumerate(texts):
        for i, line in enumerate((t or "").split("\n")):
            line = line.strip(" \t\r\x0b\x0c")
            if len(line) >= 20:
                first.setdefault(line, (d, i))
                occ.append((d, i, line))
    links = [(first[a], first[b]) for a, b in combinations(first, 2) if edit_distance(a, b) <= k]
    at = smallest_reachable(first.values(), links)
    want = {(d, i): at[first[line]] for d, i, line in occ}
    rows = line_rows(docs_of(spark, texts))
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in rows.collect()}
    assert got == want and links
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    left = {r.doc_id: r.text for r in without_repeats(docs_of(spark, texts)).collect()}
    for d, t in enumerate(texts):
        lines = (t or "").split("\n")
        keep = [x for i, x in enumerate(lines) if want.get((d, i), (d, i)) == (d, i)]
        if len(keep) < len(lines) and not any(x.strip() for x in keep):
            assert d not in left
        else:
            assert left[d] == (t if len(keep) == len(lines) else "\n".join(keep))


def test_banded_distance_equals_levenshtein(spark):
    rnd, rows = random.Random(9), []
    for _ in range(800):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randrange(3, 30)))
        b = edited(rnd, a, rnd.randrange(min(5, len(a))))
        rows.append((a, b) if len(a) >= len(b) else (b, a))
    df = spark.createDataFrame(rows, "p string, q string").where("char_length(q) > 0")
    df = df.select("p", "q", F.split("p", "").alias("x"), F.split("q", "").alias("y"))
    for k in (1, 2, 3):
        assert df.where((F.levenshtein("p", "q") <= k) != edits_within("x", "y", k)).count() == 0


def test_probes_are_the_multi_match_aware_ones():
    assert [len(probe_shifts(2, d)) for d in range(3)] == [5, 4, 3]


def test_edges(spark):
    assert line_rows(docs_of(spark, [])).collect() == []
    long = "z" * 6_000
    df = spark.createDataFrame(
        [(1, long, "a", 1), (None, long[:-1], "b", 2), (1, long, "c", 3), (2, "unlike anything else here", "d", 4)],
        "doc_id long, text string, line string, id long")
    got = sorted((str(r.doc_id), r.class_doc_id, r.kept) for r in line_rows(df).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("None", 1, False)]
    left = without_repeats(df)
    assert left.columns == df.columns and left.count() == 3


def test_equal_short_lines_in_the_query_and_the_stage(spark, workdir):
    texts = ["Menu\nthe first line of some length\n x ", "Menu \n\nthe second line of some length\nx", "menu\nMenus\n  \nx\r",
             "Menu\n x", None, "", "the first line of some length!\nMenu"]
    docs_of(spark, texts).write.parquet(f"{workdir}/documents.parquet")
    rows = QUERIES["op2_line_dedup"](spark, workdir).collect()
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in rows}
    own = lambda *at: {a: a for a in at}
    assert got == own((0, 0), (0, 1), (0, 2), (1, 2), (2, 0), (2, 1)) | {
        (1, 0): (0, 0), (1, 3): (0, 2), (2, 3): (0, 2), (3, 0): (0, 0), (3, 1): (0, 2), (6, 0): (0, 1), (6, 1): (0, 0)}
    assert all(r.kept == (got[r.doc_id, r.line_no] == (r.doc_id, r.line_no)) for r in rows)
    left = {r.doc_id: r.text for r in stages.line_dedup(spark, docs_of(spark, texts), workdir).collect()}
    assert left == {0: texts[0], 1: "\nthe second line of some length", 2: "menu\nMenus\n  ", 4: None, 5: ""}


def test_far_pairs_do_not_reach_the_automaton(spark):
    lines = spark.createDataFrame(
        [(1, "the cat sat on the mat at noon"), (2, "the cat sat on a mat at noon!"), (3, "ten tam cat heat on the masts on")],
        "id long, line string").withColumn("chars", F.char_length("line"))
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    near = verify(pairs, lines, 4)
    assert [tuple(r) for r in near.collect()] == [(1, 2)]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("aggregate(") < plan.index("levenshtein(")  # above it in the plan


def test_finer_keys_equal_brute_force(spark, monkeypatch):
    from checkup.llm import line_dedup as ld

    # every group with a member outside is crowded, down to blocks of one or two characters
    monkeypatch.setattr(ld, "CROWDED", 0)
    monkeypatch.setattr(ld, "FINER", (4, 24))
    test_classes_equal_brute_force(spark)


def test_block_keys_join_every_near_pair(spark):
    from checkup.llm.line_dedup import block_keys_of

    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdef ") for _ in range(23))
    lines = sorted({base, *(edited(rnd, base, rnd.randrange(1, 3)) for _ in range(60))})
    df = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(lines)], "id long, chars int, line string")
    want = {(a, b) for a, b in combinations(range(len(lines)), 2) if edit_distance(lines[a], lines[b]) <= 2}
    for blocks in (8, 26):  # 26: more blocks than characters
        groups = {}
        for r in block_keys_of(df, 2, blocks).collect():
            groups.setdefault(r.key, {}).setdefault(r.id, set()).add(r.owner)
        met = {p for g in groups.values() for p in combinations(sorted(g), 2) if any(1 in g[x] for x in p)}
        assert want and want <= met


def test_large_group_of_far_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    from checkup.llm import line_dedup as ld

    compared, verify_ = [], ld.verify
    monkeypatch.setattr(ld, "verify", lambda pairs, *a: (compared.append(pairs.count()), verify_(pairs, *a))[1])
    rnd, n = random.Random(9), 120
    base = ["".join(rnd.choice("abcdefghij") for _ in range(9)) for _ in range(30)]

    def far():  # words put in at three places of the last two thirds: the first third stays
        words = list(base)
        for _ in range(3):
            words.insert(rnd.randrange(11, len(words)), "".join(rnd.choice("klmnop") for _ in range(rnd.randrange(4, 7))))
        return " ".join(words)

    texts = [far() for _ in range(n)]
    near = edited(rnd, texts[5], 2)
    rows = line_rows(docs_of(spark, [*texts, near]), min_exact=1).collect()
    assert {r.doc_id: r.class_doc_id for r in rows} == {**{i: i for i in range(n)}, n: 5}
    assert sum(compared) < 12 * n  # all pairs: 7,140
