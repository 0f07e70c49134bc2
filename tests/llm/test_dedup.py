"""SimHash classes, line dedup and the pipeline against plain definitions."""

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import line_dedup, simhash
from larkspur.llm.queries import QUERIES


def brute_fingerprint(t, k=4):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(values: list[int], radius=4) -> list[int]:
    """For each value the least index of its class."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints(docs):
    texts = [r.text for r in docs.select("text").collect()] + ["", " ", "a", "a b", "A b c", "a b c d", "a b c d e", "é\x0bb\x1cc d e", "ÀB c"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def test_bk_tree_and_forest():
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(30)]
    values = list({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 6))) & (2**64 - 1) for b in base for _ in range(8)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.near(q, 4)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 4]
    third = len(values) // 3
    sets, chunks = simhash.Sets(), [values[:third], values[third : 2 * third], values[2 * third :]]
    made = [simhash.forest(c, 4) for c in chunks]
    searcher = simhash.Searcher({7: [(i, t.to_bytes(r)) for i, (t, r) in enumerate(made)]}, 4)
    for i, (c, (_, roots)) in enumerate(zip(chunks, made, strict=True)):
        for v, r in zip(c, roots, strict=True):
            sets.join(v, r)
            for a, b in searcher.links(7, i, v, r):
                sets.join(a, b)
    want = brute_classes(values)
    assert all((sets.find(values[i]) == sets.find(values[j])) == (want[i] == want[j]) for i, j in itertools.combinations(range(len(values)), 2))
    back, roots = simhash.BKTree.from_bytes(made[0][0].to_bytes(made[0][1]))
    assert (back.values, back.children, roots) == (made[0][0].values, made[0][0].children, made[0][1])


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_masks_lose_nothing(blocks):
    """Any four differing bits leave a table in which both agree."""
    r = random.Random(blocks)
    masks = simhash.masks(blocks)
    assert len(masks) == len(set(masks))
    for _ in range(3000):
        x = sum(1 << b for b in r.sample(range(64), 4))
        assert any(x & m == 0 for m in masks)


@pytest.mark.parametrize(("chunk", "round_bytes"), [(1024, 1 << 20), (3, 1 << 20), (3, 200)])
def test_links_and_components(spark, chunk, round_bytes):
    r = random.Random(11)
    base = [r.getrandbits(64) for _ in range(40)]
    values = sorted({(b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 5)))) for b in base for _ in range(r.randint(1, 9))})
    df = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    found = simhash.components(simhash.links(df, len(values), 4, chunk, round_bytes))
    root = {r.node & (2**64 - 1): r.root for r in found.collect()}
    want = brute_classes(values)
    for i, j in itertools.combinations(range(len(values)), 2):
        a, b = (root.get(values[k], simhash._signed(values[k])) for k in (i, j))
        assert (a == b) == (want[i] == want[j])


def test_one_dense_class(spark):
    """20,000 different fingerprints around one, and 2,000 that stand alone."""
    r = random.Random(13)
    base = r.getrandbits(64)
    near = {base}
    while len(near) < 20_000:
        near.add(base ^ sum(1 << x for x in r.sample(range(64), r.randint(1, 4))))
    alone = {r.getrandbits(64) for _ in range(2000)} - near
    df = spark.createDataFrame([(simhash._signed(v),) for v in sorted(near | alone)], "fp long").repartition(4)
    found = simhash.components(simhash.links(df, len(near | alone)))
    root = {x.node & (2**64 - 1): x.root for x in found.collect()}
    assert len({root.get(v) for v in near - {min(near, key=simhash._signed)}}) == 1 and not any(v in root for v in alone)


def test_long_chain(spark):
    """A path of hundreds of links is one class."""
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {(r.root) for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_of_all(spark, docs):
    rows = simhash.near_duplicates(docs).collect()
    src = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(src)
    want = brute_classes([brute_fingerprint(src[i]) for i in ids])
    assert {r.doc_id: r.component_id for r in rows} == {i: ids[w] for i, w in zip(ids, want, strict=True)}


def test_no_written_plan_repeats_another(spark, docs, monkeypatch):
    """The driver holds each plan, anew after each stage: none reads more tables than one join of hot keys does."""
    reads = {}

    def seen(df, tag, write=simhash.materialize):
        reads[tag] = max(reads.get(tag, 0), df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return write(df, tag)

    monkeypatch.setattr(simhash, "materialize", seen)
    found = simhash.near_duplicates(docs)
    reads["all"] = found._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert max(reads.values()) <= 8, reads


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert by[1, 0] == by[2, 0] == by[3, 0] == by[None, 0] == 1 and len({v for k, v in by.items() if k[0] in (4, 5)}) == 1
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(repr(r.doc_id) for r in kept.collect())
    assert ids.count("1") == 1 and "2" not in ids and "5" not in ids and ids.count("9") == 1 and ids.count("7") == 1 and ids.count("None") == 1
    assert simhash.keep_first(no_docs).collect() == []


# ---- line dedup


BLANKS = line_dedup.BLANKS


def n_words(line: str) -> int:
    return len([w for w in re.split(f"[{BLANKS}]", line) if w])


def brute_removed(docs: dict, least=50) -> dict:
    """By definition: places among non-blank lines in a run of `least` words or more that stands at an earlier place as well."""
    lines = {k: [x for x in (y.strip(BLANKS) for y in (v or "").split("\n")) if x] for k, v in docs.items()}
    seen, out = {}, {}
    for k in sorted(docs):
        own = lines[k]
        gone = [False] * len(own)
        for i in range(len(own)):
            for e, j in seen.get(own[i], ()):
                if i and j and own[i - 1] == lines[e][j - 1]:
                    continue
                a, b = i, j
                while a < len(own) and b < len(lines[e]) and own[a] == lines[e][b]:
                    a, b = a + 1, b + 1
                if sum(map(n_words, own[i:a])) >= least:
                    gone[i:a] = [True] * (a - i)
            seen.setdefault(own[i], []).append((k, i))
        out[k] = gone
    return out


def test_line_dedup_of_all(docs):
    src = {r.doc_id: r.text for r in docs.collect()}
    want = brute_removed(src)
    got = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert {k: r.n_removed for k, r in got.items()} == {k: sum(v) for k, v in want.items()}
    for k, r in got.items():
        rest = [x for x, g in zip([y for y in src[k].split("\n") if y.strip(BLANKS)], want[k], strict=True) if not g]
        assert [y for y in r.text.split("\n") if y.strip(BLANKS)] == rest


def test_every_repeated_run_is_found(spark):
    """Passages of 50 words and more, in lines of any length, in any surroundings."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    line = lambda: " ".join(word() for _ in range(r.choice((1, 2, 5, 12, 30, 70))))
    common = [line() for _ in range(3)]
    passages = []
    for _ in range(30):  # some hold lines of others, so a line's first holder need not be its passage's
        p = []
        while sum(map(n_words, p)) < 50:
            p.append(r.choice((line(), line(), r.choice(common), r.choice(r.choice(passages or [common])))))
        passages.append(p)
    texts = {}
    for k in range(120):
        t = []
        for _ in range(r.randint(1, 6)):
            t += r.choice(([line()], [r.choice(common)], r.choice(passages), r.choice(passages)))
        texts[k] = "\n".join(t)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(df).collect()}
    want = {k: sum(v) for k, v in brute_removed(texts).items()}
    owed = sum(want.values())
    assert owed > 100 and got == want


def test_words_are_runs_of_other_signs(spark):
    """Tabs, no-break and ideographic spaces part words; a run of spaces is one break."""
    word = [f"w{i}" for i in range(60)]
    for sep, gone in (("\t", 1), ("\xa0", 1), ("\u3000", 1), (" \t ", 1), ("-", 0)):
        line = sep.join(word)
        rows = [(1, line), (2, f"top\n{line}")]
        got = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {1: 0, 2: gone}, repr(sep)
    table = "\n".join("a" + " " * 60 + "b" for _ in range(3))  # six words
    assert [r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame([(1, table), (2, table)], "doc_id long, text string")).collect()] == [0, 0]


def test_only_blanks_are_trimmed(spark):
    """Lines that differ in digits at their ends are different, and spaces around a line are not part of it."""
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(k, "\n".join((f"{k}0", f" {body}" if k % 2 else f"{body}  ", f"{k}1", f"2{k}"))) for k in range(4)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (rows[0][1], 4, 0)} | {k: (f"{k}0\n{k}1\n2{k}", 4, 1) for k in range(1, 4)}


def test_one_passage_in_many_documents(spark):
    """A licence text in 20,000 documents, alone, after and before other lines; its first place alone keeps it."""
    licence = "\n".join(" ".join(f"l{i}w{j}" for j in range(12)) for i in range(6))
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.concat(F.lit("own "), F.col("id").cast("string"), F.lit("\n")), F.lit(licence), F.when(F.col("id") % 2 == 0, F.concat(F.lit("\nend "), F.col("id").cast("string"))).otherwise("")).alias("text"))
    got = line_dedup.line_dedup(rows)
    counts = {tuple(r) for r in got.groupBy(F.col("doc_id") == 0, "n_removed").count().collect()}
    assert counts == {(True, 0, 1), (False, 6, n - 1)}
    assert got.where("doc_id = 7").first().text == "own 7" and got.where("doc_id = 8").first().text == "own 8\nend 8"


def test_line_dedup_of_odd_rows(odd_docs, no_docs):
    got = line_dedup.line_dedup(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[1][0].n_lines == 0 and by[2][0].text == "" and by[3][0].text == "   \n\t\n "
    assert by[4][0].n_removed == 0 and all(r.n_removed == r.n_lines == 900 and r.text == "" for r in by[5])
    assert by[6][0].n_removed == 0 and {r.text for r in by[7]} == {"first", "another text of seven"}
    assert line_dedup.line_dedup(no_docs).collect() == []


def test_blank_lines(spark):
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, f"{a}\n{b}"), (2, f"top\n\n{a}\n\n\n  {b}\t\n\nend"), (3, f"\n{a}\n")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 2, 0), 2: ("top\n\n\nend", 4, 2), 3: ("", 1, 1)}


def test_no_python_in_line_dedup(spark, data):
    plan = QUERIES["op9_line_dedup"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- pipeline


def test_pipeline(spark, docs, data):
    import corpus_pipeline as P

    now = docs
    for name, stage in P.STAGES:
        out = stage(spark, now, data)
        if name != "sentencepiece":
            assert out.columns == docs.columns, name
        before = {r.doc_id: r.text for r in now.collect()}
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "language_id":
            assert set(before) == set(after)
        elif name == "line_dedup":
            gone = brute_removed(before)
            assert set(before) - set(after) == {k for k, v in gone.items() if v and all(v)}
        elif name == "near_duplicates":
            ids = sorted(before)
            assert {ids[i] for i in brute_classes([brute_fingerprint(before[i], 5) for i in ids])} == set(after)
        elif name == "decontamination":
            from test_text import brute_contamination

            items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
            for k, t in before.items():
                n, hit, _ = brute_contamination(t, items)
                assert (k in after) == (not (hit and 20 * hit >= n))
        else:
            assert all(r.parity and r.round_trip for r in after.values()) and set(after) == set(before)
        now = out
    assert {r.doc_id for r in P.run(spark, data).collect()} == {r.doc_id for r in now.select(F.col("doc_id")).collect()}


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, data):
    import corpus_pipeline as P

    for docs in (odd_docs, no_docs):
        now = docs
        for name, stage in P.STAGES:
            now = stage(spark, now, data)
            if name != "sentencepiece":
                assert now.columns == docs.columns
        now.collect()
