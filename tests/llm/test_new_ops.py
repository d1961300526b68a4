"""Piece tables, the positional index and the manifest against brute force and round trips."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from compoundry.llm import merkle_manifest, piece_table, positional_index

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def fim(key, text, unit="line", rate=100, spm=50, seed="7", marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = [int(sha(f"{seed}:{'' if key is None else key}")[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < spm:
        return n, "spm", len(pre), len(mid), marks[1] + suf + marks[0] + pre + marks[2] + mid
    return n, "psm", len(pre), len(mid), marks[0] + pre + marks[1] + suf + marks[2] + mid


@pytest.mark.parametrize("rules", [piece_table.FimRules(), piece_table.FimRules("char", "x", 70, 20, ("[p]", "[s]", "[m]"))])
def test_fill_in_middle(spark, docs, rules):
    awkward = [(100 + i, t, None, None, None) for i, t in enumerate(
        ["\n", "\n\n", "no end", "a\nb", "a\r\nb\r\n", "has <P> inside\nmore\n", "<M>", "<", "P>\n<S", "é\n☃\n\U0001f600", "[p] x\ny", "x\n" * 5000])]
    df = docs.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).unionByName(spark.createDataFrame(awkward, SCHEMA))
    df = df.withColumns({"_form": F.lit("mine"), "c0": F.lit(1), "key": F.lit("k"), "extra": F.lit(2)})
    out = piece_table.fill_in_middle(df, rules)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "c0", "key", "extra", *piece_table.RESULTS, "_output"]
    rows = piece_table.restore_texts(out, rules).collect()
    assert len(rows) == df.count()
    for r in rows:
        want = fim(r["doc_id"], r["text"], rules.unit, rules.rate, rules.spm_rate, rules.seed, rules.sentinels)
        assert (r["_n_units"], r["_form"], r["_prefix_chars"], r["_middle_chars"], r["_output"]) == want, r["doc_id"]
        assert r["_output_sha256"] == sha(want[4]) and r["_restored"] == (r["text"] or "") and r["_restored_sha256"] == sha(r["text"] or "")
    assert {r["_form"] for r in rows} == {"plain", "spm", "psm"}
    assert piece_table.fill_in_middle(df.where("1 = 0"), rules).count() == 0


def test_piece_table_moves_descriptors_only():
    text = b"abcdef"
    table = piece_table.PieceTable.over(memoryview(text), memoryview(b"123")).cut(1, 1, 2).cut(0, 2, 2)
    assert table.pieces == [(0, 0, 2), (0, 2, 2), (0, 2, 6), (1, 0, 1), (1, 1, 2), (1, 2, 3)]
    for order in ((5, 3, 1, 0, 2, 4), (0, 1, 2, 3, 4, 5)):
        moved = table.arranged(order)
        assert moved.restored(order).pieces == table.pieces and moved.buffers is table.buffers
        assert moved.sha256() == sha(moved.joined())
    for bad in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("", "b", "c"), ("x", "axb", "c")):
        with pytest.raises(ValueError):
            piece_table.FimRules(sentinels=bad)


WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def index_words(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))


def phrases(texts, items, size):
    """Per row of ``texts``: words, hit words, items."""
    wins = {}
    for item, text in items:
        w = index_words(text)
        n = min(size, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[j : j + n]), set()).add(str("" if item is None else item))
    lengths = {len(w) for w in wins}
    out = []
    for text in texts:
        w, hit, found = index_words(text), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                got = wins.get(tuple(w[j : j + n]))
                if got:
                    hit |= set(range(j, j + n))
                    found |= got
        out.append((len(w), len(hit), sorted(found)))
    return out


def spans_near(w, terms, within):
    """Smallest spans: no other span inside."""
    found = []
    for a in range(len(w)):
        left = set(terms)
        for b in range(a, min(len(w), a + within)):
            left.discard(w[b])
            if not left:
                found.append((a, b + 1))
                break
    return {s for s in found if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in found)}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    vocabulary = ["the", "the", "the", "of", "é", "naïve", "x1", "Big", "cat", "dog", "runs"] + [f"rare{i}" for i in range(40)]

    def sentence(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", " \t", "."]) for _ in range(n))

    items = [(i, sentence(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "the the the the the the the the the the"), (103, "!!!"), (3, "another text of item three " * 2), (None, "x1 big")]
    texts = []
    for i in range(120):
        t = sentence(rng.choice([0, 1, 5, 40, 200]))
        if i % 3 == 0:
            t += " " + (rng.choice(items)[1] or "").upper() + " " + sentence(rng.choice([0, 3]))
        texts.append((i if i % 7 else None, t))
    texts += [(500, None), (501, ""), (502, "the " * 400), (503, " ".join(f"w{k}" for k in range(3000))), (503, "x1"), (504, items[4][1]), (504, items[4][1])]
    return texts, items


@pytest.mark.parametrize(("segment", "chunk", "candidates"), [(500_000, 65_536, 1_000_000), (60, 3, 17)])
def test_positional_index(spark, corpus, monkeypatch, segment, chunk, candidates):
    monkeypatch.setattr(positional_index, "CHUNK_WINDOWS", chunk)
    texts, items = corpus
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "doc_id long, text string, segment string, place int")
    bench = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, window string")
    # the size of a segment is read where workers import the module: small ones by few rows per task
    index = positional_index.build_index(docs if segment > 1000 else docs.repartition(40))
    matches = positional_index.contamination(index, bench, 10).collect()
    want = phrases([t for _, t in texts], items, 10)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], list(r["items"])) for r in matches))
    assert got == sorted((i is None, i or 0, n, h, s) for (i, _), (n, h, s) in zip(texts, want, strict=True))
    for r in matches:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    assert any(r["n_hit"] for r in matches) and not all(r["n_hit"] for r in matches)


@pytest.mark.parametrize("within", [3, 6])
def test_proximity(spark, corpus, within):
    texts, _ = corpus
    texts = [(i, t) for i, (_, t) in enumerate(texts)]
    items = [(0, "the cat dog"), (1, "rare1 the"), (2, "naïve É x1 the"), (3, "the the"), (4, "absentword the"), (5, "rare3")]
    index = positional_index.build_index(spark.createDataFrame(texts, "doc_id long, text string"))
    windows = positional_index.item_windows(spark.createDataFrame(items, "item_id long, text string"), 10)
    rows = positional_index.near_matches(index, windows, within).join(windows.select("window", "item").distinct(), "window").collect()
    got = {(r["doc_id"], int(r["item"]), r["start"], r["end"]) for r in rows}
    assert len(got) == len(rows)
    assert got == {(i, k, *s) for i, t in texts for k, q in items for s in spans_near(index_words(t), set(index_words(q)), within)}


def test_positional_index_of_empty_tables(spark, corpus):
    texts, items = corpus
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = positional_index.contamination(positional_index.build_index(docs), bench.where("1 = 0")).collect()
    assert len(out) == len(texts) and not any(r["n_hit"] or r["items"] or r["spans"] for r in out)
    assert positional_index.contamination(positional_index.build_index(docs.where("1 = 0")), bench).count() == 0
    nothing = positional_index.build_index(docs.where("text is null or text = ''"))
    assert {r["n_hit"] for r in positional_index.contamination(nothing, bench).collect()} == {0}


def tree(nodes, arity):
    """Root and, per leaf, the siblings level by level with its place."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for leaf, i in enumerate(at):
            run = runs[i // arity]
            paths[leaf].append((i % arity, run[: i % arity] + run[i % arity + 1 :]))
        at = [i // arity for i in at]
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def leaf(r, add=0):
    values = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + add, r["text"]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def manifest(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g, rs in groups.items():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in rs], arity)
    root, tops = tree([trees[g][0] for g in order], arity)
    out = []
    for g, top in zip(order, tops, strict=True):
        for r, path in zip(groups[g], trees[g][1], strict=True):
            steps = path + top
            touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            h = leaf(r, int(touched))
            for place, others in steps:
                h = sha("".join([*others[:place], h, *others[place:]]))
            out.append((r["doc_id"], leaf(r), trees[g][0], root, sha("".join(x for _, o in steps for x in o)), h, h == root))
    return sorted(out, key=str)


def test_merkle_manifest_query(spark, docs, tmp_path):
    df = docs.withColumns({"digest": F.lit("d"), "k": F.lit("k"), "pos": F.lit(1), "n": F.lit(2), "root": F.lit(3)})
    df = df.withColumn("n_chars", F.when(F.col("doc_id") == 9, None).otherwise(F.col("n_chars")))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in merkle_manifest.op13_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == manifest([r.asDict() for r in df.collect()])
    assert {g[-1] for g in got} == {True, False}
    empty = tmp_path / "none"
    df.where("1 = 0").write.parquet(str(empty / "documents.parquet"))
    assert merkle_manifest.op13_merkle_manifest(spark, str(empty)).count() == 0


@pytest.mark.parametrize(("arity", "levels", "sizes"), [(2, 1, [1, 2, 9]), (2, 3, [8, 64, 65, 1, 7]), (3, 2, [28, 3, 10]), (5, 1, [26])])
def test_manifest_of_many_blocks(spark, arity, levels, sizes):
    rows, i = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            i += 1
            rows.append({"doc_id": (i * 37) % 1009, "text": f"t{i}", "lang": f"l{g}" if g else None, "source": None, "n_chars": i})
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    leaves = df.select("doc_id", "lang", F.unhex(merkle_manifest.leaf_digest([F.col(f) for f in merkle_manifest.FIELDS])).alias("digest"))
    leaves = leaves.repartition(7)
    made = merkle_manifest.build_manifest(leaves, "lang", ["doc_id"], arity, levels)
    assert sorted(r["n_leaves"] for r in made.groups.collect()) == sorted(sizes)
    out = merkle_manifest.verify(merkle_manifest.Manifest(made.leaves.withColumn("offered", F.col("digest")), made.groups), "offered", ["doc_id"])
    got = {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in out.collect() if r["verified"]}
    want = {r[0]: r[1:5] for r in manifest(rows, arity)}
    assert got == want


def test_frontier_extends_partial_witnesses():
    grown = merkle_manifest.Frontier(2, 3)
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(5)]
    for i, d in enumerate(digests):
        grown.append(d)
        assert len(list(merkle_manifest.steps_of(bytes(grown.witnesses[0])))) == [0, 1, 1, 2, 2][i]
    root = grown.close()
    assert all(merkle_manifest.folded(d, bytes(w)) == root for d, w in zip(digests, grown.witnesses, strict=True))
    assert merkle_manifest.folded(digests[1], bytes(grown.witnesses[0])) != root


def test_rows_that_share_an_id_keep_their_own_text(spark):
    from compoundry.llm import substring_words

    shared = " ".join(f"s{i}" for i in range(25))
    rows = [(None, " ".join(f"a{i}" for i in range(20)) + " " + shared), (None, shared + " " + " ".join(f"b{i}" for i in range(20))),
            (3, "c0 c1 " + shared), (3, " ".join(f"d{i}" for i in range(30))), (3, " ".join(f"d{i}" for i in range(30)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_words.remove_repeated_windows(df, 10).collect()
    removed = sorted((r["_n_removed"] for r in out))
    # one of the two null rows keeps the passage, whole; the other and the row with an id lose it; equal rows are one
    assert removed == [0, 0, 0, 25, 25]
    assert all(r["_kept"].startswith("a0 ") or r["_kept"].endswith("b19") for r in out if r["doc_id"] is None)
    assert [r["_kept"] for r in out if r["text"].startswith("c0")] == ["c0 c1"]


def test_clashing_extra_columns(spark):
    import corpus_pipeline
    from compoundry.llm import pfair_mix, quality_rules

    names = ["_id", "_key", "_doc", "_same", "_block", "_kept", "_text", "_ws", "host", "doc", "line", "n", "col1"]
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "s", 300) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    judged = quality_rules.judge(df).collect()
    assert {r["_id"] for r in judged} == {f"_id{i}" for i in range(6)} and {r["_ws"] for r in judged} == {f"_ws{i}" for i in range(6)}
    mixed = pfair_mix.mix(df).collect()
    assert {r["_id"] for r in mixed} == {f"_id{i}" for i in range(6)} and all(isinstance(r["_block"], int) for r in mixed)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, df, "")
        assert got.columns == df.columns, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got.collect() for c in names) and got.count() == 6


def test_scratch_tables_go_and_those_that_outlive_stay(spark):
    from compoundry.llm import common

    with common.scratch(spark):
        gone = common.write_once(spark.range(3), "gone")
        kept = common.write_once(gone.where("id > 0"), "kept", outlive=True)
    assert kept.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(gone.inputFiles()[0]).count()
    assert common.free_name(["_a", "__A"], "_a") == "___a" and common.free_name([], "x") == "x"


def test_katz_group_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from compoundry.llm import katz

    v = katz.Vocabulary(0, 0, 1.0, katz.discounts([0] * 6), np.zeros(0, np.uint64), np.zeros(0, np.int64), 16)
    words = np.random.default_rng(3).integers(0, 90_000, (400, 1000))
    texts = [" ".join(f"w{i}" for i in row) for row in words]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts), pa.array([i % 7 != 2 for i in range(400)])], ["id", "text", "train"])
    dealt = list(katz._deal_pairs(v)(iter([batch])))
    tracemalloc.start()
    try:
        made = list(katz._count_pairs(v)((0,), iter(dealt)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    sums = [katz._get(x, 10) for m in made for kind, x in zip(m.column("kind").to_pylist(), m.column("blob").to_pylist(), strict=True) if kind == 0]
    assert sum(int(s[1].sum()) for s in sums) == 400 * 1001
    assert peak < 140 * 400 * 1001
