"""Jaccard join, line chunks, super-k-mers and SimHash against brute force."""

import hashlib
import math
import sys
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from cases import DOCS, corpus, documents

from kinegrid.llm import jaccard, lines, simhash, superkmers

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, n):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(ids, linked):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_answers(rows, n, percent):
    """(doc_id, n_shingles, class_id, component_id, n_links) of each (doc_id, text), by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    linked = [(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x and 100 * len(x & y) >= percent * len(x | y)]
    root = groups(range(len(rows)), linked)
    least, degree = {}, [0] * len(rows)
    for i, (doc, _) in enumerate(rows):
        least[root[i]] = min(doc, least.get(root[i], doc))
    for i, j in linked:
        degree[i] += 1
        degree[j] += 1
    classes = {}
    for (doc, _), x in zip(rows, sets):
        classes[frozenset(x)] = min(doc, classes.get(frozenset(x), doc))
    return sorted((doc, len(x), classes[frozenset(x)] if x else doc, least[root[i]], degree[i]) for i, ((doc, _), x) in enumerate(zip(rows, sets)))


def around(seed, copies, words=120, most=30, start=0):
    """Copies of one text with up to `most` words changed, so that pairs lie on both sides of the threshold; all begin alike."""
    import random

    rng, out = random.Random(seed), []
    base = [f"b{i}" for i in range(words)]
    for _ in range(copies):
        text = [*base]
        for _ in range(rng.randint(0, most)):
            text[rng.randrange(8, words)] = f"e{rng.randrange(40)}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (1, 60, 3), (2, 95, 4)])
def test_jaccard_equals_brute_force(spark, n, percent, seed):
    texts = corpus(seed) + around(seed, 60, 90, 12) + around(seed + 9, 40, 40, 3)
    got = sorted(tuple(r) for r in jaccard.classes(documents(spark, texts).repartition(5), n, percent).collect())
    assert got == jaccard_answers([(3 * i, t) for i, t in enumerate(texts)], n, percent)


def test_jaccard_in_blocks(spark, monkeypatch):
    """Stars of many blocks, tables of few rows."""
    monkeypatch.setattr(jaccard, "BLOCK", 900)
    monkeypatch.setattr(jaccard, "CELLS", 300)
    texts = around(5, 150, 80, 8) + around(6, 60, 80, 8)
    got = sorted(tuple(r) for r in jaccard.classes(documents(spark, texts).repartition(5), 3, 80).collect())
    want = jaccard_answers([(3 * i, t) for i, t in enumerate(texts)], 3, 80)
    assert got == want and len({x[3] for x in want}) > 5 and max(x[4] for x in want) > 20


def test_copies_around_the_threshold_share_a_star(spark, monkeypatch):
    """What is compared grows with the copies, not with their pairs, also where few of them link."""
    import random

    compared = []

    def counted(step):
        def run(*args):
            out = step(*args)
            compared.append(out.count())
            return out

        return run

    for name in ("differences", "near_stars"):
        monkeypatch.setattr(jaccard, name, counted(getattr(jaccard, name)))
    rng, texts = random.Random(8), []
    for _ in range(160):
        text = [f"b{i}" for i in range(300)]
        for _ in range(4):
            text[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(text))
    got = sorted(tuple(r) for r in jaccard.classes(documents(spark, texts).repartition(5), 4, 85).collect())
    want = jaccard_answers([(3 * i, t) for i, t in enumerate(texts)], 4, 85)
    assert got == want and len({x[3] for x in want}) > 40 and sum(x[4] for x in want) > 60
    assert sum(compared) < 5 * len(texts)


def test_jaccard_of_ids_that_repeat(spark):
    texts = corpus(3, 24)
    rows = [(i % 20, t) for i, t in enumerate(texts)] + [(2, texts[2]), (5, texts[7]), (None, texts[0])]
    df = spark.createDataFrame([(i, t, f"s{k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, first string")
    got = sorted(tuple(r) for r in jaccard.classes(df).collect())
    assert got == jaccard_answers(rows[:-1], 5, 80)
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    kept, sets = kept.collect(), [shingles(t, 5) for _, t in rows[:-1]]
    root = groups(range(len(sets)), [(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x and 100 * len(x & y) >= 80 * len(x | y)])
    assert sum(r.doc_id is not None for r in kept) == len({*root.values()}) and sum(r.doc_id is None for r in kept) == 1
    assert {root[int(r["first"][1:])] for r in kept if r.doc_id is not None} == {*root.values()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert jaccard.classes(none, 4, 85).count() == 0
    assert lines.dedup(none).count() == 0
    assert superkmers.remove_repeats(none).count() == 0
    assert simhash.edited_fingerprints(none).count() == 0


def remove_windows(texts, size):
    seen, out = set(), []
    for t in texts:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "size"), [(1, 20), (4, 20), (5, 12)])
def test_windows_equal_brute_force(spark, seed, size):
    texts = corpus(seed) + ["again and again " * 40, "again and again " * 9]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in superkmers.remove_repeats(documents(spark, texts).repartition(4), size).collect()}
    assert got == {3 * i: x for i, x in enumerate(remove_windows(texts, size))}


def spark_hash(values):
    """Spark's xxhash64 of some columns."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed=seed)
    return seed


def line_chunks(rows, chunkings, least):
    """(start, end) of the chunks of lines, by looking from each opening window for the next mark."""
    h = [spark_hash([x]) for x in rows]
    rolled = [spark_hash(h[i : i + least]) for i in range(len(rows) - least + 1)]
    out = set()
    for s in range(chunkings):
        value = [x >> 3 * s & 7 for x in rolled]
        for i, v in enumerate(value):
            if v < 4:
                out.add((i, i + least))
            elif v == 4:
                j = next((j for j in range(i + 1, len(value)) if value[j] < 6), None)
                if j is not None and value[j] == 5:
                    out.add((i, j + least))
    return out


@pytest.mark.parametrize(("chunkings", "least", "grow"), [(8, 2, 2), (1, 2, 0), (1, 2, 3), (3, 3, 1)])
def test_lines_equal_brute_force(spark, chunkings, least, grow):
    texts = corpus(6) + ["x\nx\nx\nx\ny", "é\n\n☃", "z\né\n\n☃"]
    split, first = [(t or "").split("\n") for t in texts], {}
    for d, rows in enumerate(split):
        for a, b in line_chunks(rows, chunkings, least):
            key = tuple(rows[a:b])
            first[key] = min((d, a), first.get(key, (d, a)))
    want = {}
    for d, rows in enumerate(split):
        laid = {}
        for a, b in line_chunks(rows, chunkings, least):
            at = first[tuple(rows[a:b])]
            if at < (d, a):
                laid.setdefault((at[0], a - at[1]), set()).update(range(a, b))
        gone = set()
        for (other, shift), covered in laid.items():
            for a in sorted(x for x in covered if x - 1 not in covered):
                b = next(x for x in range(a, len(rows) + 1) if x not in covered)
                near = [x for x in range(max(0, shift, a - grow), min(len(rows), b + grow)) if x - shift < len(split[other]) and rows[x] == split[other][x - shift]]
                for x in near:
                    if {*range(x, x + least)} <= {*near}:
                        gone |= {*range(x, x + least)}
        want[3 * d] = (None if texts[d] is None else "\n".join(x for k, x in enumerate(rows) if k not in gone), len(gone))
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(documents(spark, texts).repartition(4), chunkings, least, grow).collect()}
    assert got == want and sum(n for _, n in want.values()) > 10


def test_lines_of_repeated_rows_and_shifted_passages(spark):
    passage = "\n".join(f"line {i} of a passage" for i in range(30))
    df = documents(spark, ["one\n" + passage, "two\nthree\n" + passage]).union(documents(spark, ["one\n" + passage]))
    got = [(r.doc_id, r.n_removed) for r in lines.dedup(df).collect()]
    assert sorted(x for x in got if x[0] == 0) == [(0, 0), (0, 0)]
    assert next(n for i, n in got if i == 3) == 30


def remove_runs(texts, least):
    """(remaining text, lines removed): each line in `least` consecutive ones that stand earlier goes."""
    seen, out = set(), []
    for t in texts:
        rows, gone = (t or "").split("\n"), set()
        for i in range(len(rows) - least + 1):
            key = tuple(rows[i : i + least])
            gone |= {*range(i, i + least)} if key in seen else set()
            seen.add(key)
        out.append((None if t is None else "\n".join(x for k, x in enumerate(rows) if k not in gone), len(gone)))
    return out


@pytest.mark.parametrize("least", [2, 3])
def test_all_runs_of_lines_go(spark, least):
    """With as many chunkings as a hash has bits for: every repeated run, by comparing all."""
    texts = corpus(6) + ["x\nx\nx\nx\ny", "é\n\n☃", "z\né\n\n☃"]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(documents(spark, texts).repartition(4), 21, least).collect()}
    want = {3 * i: x for i, x in enumerate(remove_runs(texts, least))}
    assert got == want and sum(n for _, n in want.values()) > 10


def test_equal_hashes_are_compared_by_bytes(spark, monkeypatch):
    """Chunks whose hashes are all equal: only lines with equal bytes go."""
    real = lines.chunks
    forced = lambda *a: lines.F.transform(real(*a), lambda c: lines.F.struct(c["start"].alias("start"), c["length"].alias("length"), lines.F.lit(7).cast("long").alias("hash")))
    monkeypatch.setattr(lines, "chunks", forced)
    texts = ["a\nb\nc\nd", "e\nf\ng\nh", "a\nb\nc\ni"]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(documents(spark, texts)).collect()}
    assert got == {0: (texts[0], 0), 3: (texts[1], 0), 6: ("i", 3)}


def test_op4_and_pipeline_remove_every_short_passage(spark, tmp_path):
    import corpus_pipeline

    from kinegrid.llm.queries import QUERIES

    passages = ["\n".join(f"line {k} of short passage {p}" for k in range(2 + p % 3)) for p in range(40)]
    texts = [f"before {p}\n{x}\nafter {p}" for p, x in enumerate(passages)] + [f"other {p}\nstart\t{p}\n{x}\nand {p}\nmore {p}" for p, x in enumerate(passages)]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n_removed for r in QUERIES["op4_line_chunks"](spark, str(tmp_path)).collect()}
    assert got == {3 * i: 0 if i < 40 else 2 + i % 40 % 3 for i in range(80)}
    kept = {r.doc_id: r.text for r in corpus_pipeline.dedup_lines(spark, documents(spark, texts), str(tmp_path)).collect()}
    assert all(kept[3 * (40 + p)] == f"other {p}\nstart\t{p}\nand {p}\nmore {p}" for p in range(40))


def test_simhash_edits_and_votes(spark):
    texts = corpus(7)
    df = documents(spark, texts)
    got = {r.doc_id: r for r in simhash.edited_fingerprints(df.repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        q = len(t) // 4
        r = got[3 * i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest())
        assert r.fingerprint == fingerprint(t)
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(t or "", set()).add(got[3 * i].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    like = lambda a, b: max(0.0, math.cos(math.pi * (int(a, 16) ^ int(b, 16)).bit_count() / 128))
    for i in range(len(texts)):
        r, after = got[3 * i], got[3 * ((i + 1) % len(texts))]
        assert abs(r.near_edited - like(r.fingerprint, r.edited_fingerprint)) < 1e-12 and abs(r.near_next - like(r.fingerprint, after.fingerprint)) < 1e-12
    long = [r for i, r in got.items() if len((texts[i // 3] or "").split()) > 60 and len(set(texts[i // 3].split())) > 20]
    assert len(long) > 20 and sum(r.near_edited > 0.5 for r in long) >= 0.9 * len(long)


def fingerprint(text):
    """The votes in plain Python."""
    words = [spark_hash([w]) for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    mask = (1 << 64) - 1
    terms = [(w & ~1 & mask, 1) for w in {w: 0 for w in words}] + [(spark_hash([a, b]) | 1, 2) for a, b in zip(words, words[1:])]
    terms = [*{t: 0 for t in terms if t[1] == 1}] + [t for t in terms if t[1] == 2]
    out = ""
    for half in (0, 1):
        hashes = [(xxhash.xxh64_intdigest(half.to_bytes(4, "little"), seed=spark_hash([t])), w) for t, w in terms]
        total = sum(w for _, w in hashes)
        out += f"{sum(1 << b for b in range(64) if 2 * sum(w for h, w in hashes if h >> b & 1) > total):016x}"
    return out


def test_near_fingerprints_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(30)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 5))) for b in base for _ in range(4)] + base[:5]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v >> 64), signed(v & (1 << 64) - 1)) for v in values], "half0 long, half1 long")
    got = {(r.half0, r.half1): r.n_near for r in simhash.near(df, df, 3).collect()}
    assert got == {(signed(v >> 64), signed(v & (1 << 64) - 1)): sum((v ^ w).bit_count() <= 3 for w in values) for v in values}


def test_edited_texts_are_near(spark):
    """Copies with a word in a few dozen replaced, at a 5-word similarity of 0.8 and more."""
    import random

    rng = random.Random(12)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        edited = [*words]
        while len(a := shingles(" ".join(words), 5)) and 100 * len(a & (b := shingles(" ".join(edited), 5))) >= 80 * len(a | b):
            rows[2 * i :] = [(100 * i, " ".join(words)), (100 * i + 1, " ".join(edited))]
            edited[rng.randrange(len(edited))] = f"e{rng.randrange(3000)}"
    got = {r.doc_id: r for r in simhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    apart = lambda a, b: (int(got[a].fingerprint, 16) ^ int(got[b].fingerprint, 16)).bit_count()
    assert {i: got[i].n_near for i in range(0, 6000, 100)} == {i: sum(apart(i, j) <= simhash.RADIUS for j in got) - 1 for i in range(0, 6000, 100)}
    assert sum(apart(i, i + 1) > 3 for i in range(0, 6000, 100)) > 40 and all(got[i].n_near >= 1 for i in range(0, 6000, 100))


@pytest.mark.parametrize("radius", [0, 7, 8, 23, 26])
def test_near_of_other_radii_equals_brute_force(spark, radius):
    import random

    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(5)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 30))) for b in base for _ in range(20)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v >> 64), signed(v & (1 << 64) - 1)) for v in values], "half0 long, half1 long")
    got = {(r.half0, r.half1): r.n_near for r in simhash.near(df, df, radius).collect()}
    assert got == {(signed(v >> 64), signed(v & (1 << 64) - 1)): sum((v ^ w).bit_count() <= radius for w in values) for v in values}


def test_ids_far_apart_and_alone(spark):
    ids = [-(2**62), -5, 0, 1, 2**40, 2**62]
    df = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    assert {r.doc_id: r.next_id for r in simhash.following(df).collect()} == dict(zip(ids, ids[1:] + ids[:1]))
    assert {r.doc_id: r.next_id for r in simhash.following(df.limit(0).union(df.where("doc_id = 0"))).collect()} == {0: 0}


def test_rows_without_an_id(spark):
    passage = "a passage " * 30
    df = spark.createDataFrame([(None, passage), (None, None), (4, passage), (8, passage)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.classes(df, 4, 85).collect()} == {4: 4, 8: 4}
    assert sorted((r.doc_id or 0, r.n_removed) for r in superkmers.remove_repeats(df).collect()) == [(0, 0), (0, 0), (4, 58), (8, 60)]
    assert lines.dedup(df).count() == 4 and simhash.edited_fingerprints(df).count() == 2
