"""Operators against brute force and round trips, with awkward rows."""

import hashlib
import random
import zlib
from fractions import Fraction
from math import ceil, floor

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from compoundry.llm import (common, induced_sort, katz, pfair_mix, piece_nbest, projection_join, quality_rules, sketch_dedup, substring_words,
                            suffix_dedup, token_codes, wrapper_induction)

NULL = common.NULL_ID


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_words_and_hashes_agree_with_the_pattern():
    import pyarrow as pa

    texts = ["a b", None, "", " x ", "tail", "head tail", "é é", "A a", "a\x0bb\x0cc", "one", "one"]
    at = 0
    for lo, hi, data, offsets in common.text_slices(pa.array(texts), 8):
        w = common.words_of(data, offsets)
        got = [[data[s:e].tobytes() for s, e, r in zip(w.starts, w.ends, w.row, strict=True) if r == i] for i in range(hi - lo)]
        assert got == [brute.words(t) for t in texts[lo:hi]]
        assert lo == at
        at = hi
    assert at == len(texts)


def test_katz_scores_and_normalisation(spark, plain, docs):
    rows = [(i, t) for i, t in plain if i is not None]
    df = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    model, scores = katz.fit_and_score(df, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    want, p, uni, follow = brute.katz(rows)
    got = by_id(scores, "_doc")
    assert set(got) == set(want)
    for i, (_, n, known, _, base, score) in want.items():
        g = got[i]
        assert (g["n_tokens"], g["n_known"]) == (n, known)
        assert abs(g["base_score"] - base) < 1e-4 and abs(g["score"] - score) < 1e-4
    for a in list(follow)[:20]:
        assert abs(sum(p(b, a) for b in uni) + p(b"no such word", a) - 1) < 1e-9
    totals = model.contexts.agg(F.sum("total")).first()[0]
    assert totals == model.vocabulary.total == model.bigrams().agg(F.sum("r")).first()[0]


def test_katz_without_training_or_rows(spark, docs):
    _, scores = katz.fit_and_score(docs.limit(3), F.lit(False))
    assert all(r["score"] == 0 for r in scores.collect())
    _, scores = katz.fit_and_score(docs.where("1 = 0"), F.lit(True))
    assert scores.count() == 0


def test_suffixes_with_any_memory():
    rng = random.Random(5)
    for _ in range(80):
        text = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 60))])
        parts = list(induced_sort.suffixes_with_prefixes(text, 6, rng.choice([3, 9, 10_000])))[::-1]
        order, common_length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        for k in range(1, len(order)):
            a, b, n = text[order[k - 1] :].tolist(), text[order[k] :].tolist(), 0
            while n < min(len(a), len(b), 6) and a[n] == b[n]:
                n += 1
            assert n == common_length[k]


@pytest.mark.parametrize(("hot", "memory"), [(256, 1 << 20), (1, 50)])
def test_suffix_dedup(spark, plain, docs, monkeypatch, hot, memory):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = by_id(suffix_dedup.remove_repeated_bytes(docs, 40, 12, memory))
    raw, gone = brute.repeated_bytes(plain, 40)
    for i, r in raw.items():
        assert got[i]["_n_removed"] == sum(gone[i]), i
        assert bytes(got[i]["_kept"]) == bytes(b for b, g in zip(r, gone[i], strict=True) if not g)
        assert got[i]["part"] is not None and got[i]["id"] == "extra"


def test_projection_join(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    vectors = [b.tolist() for b in base] + [(base[i % 20] + 0.12 * rng.standard_normal(24)).tolist() for i in range(120)] + [base[0].tolist()] * 5
    vectors += [None, [], [0.0] * 24, [None, *base[1].tolist()[1:]], [float("nan")] * 24, [float("inf")] * 24, (2 * base[2]).tolist(), base[3][:12].tolist()]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, cell string, k int")
    got = by_id(projection_join.near_vectors(df), "_id")
    good = {i: np.array(v) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b])
             and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    want = brute.components(range(len(vectors)), links)
    found = sum(g["_n_links"] for g in got.values()) / 2
    assert found >= 0.99 * len(links) and found <= len(links)
    assert sum(want[i] == got[i]["_component"] for i in want) >= 0.99 * len(want)
    k, tables, least = projection_join.calibrate(10**6, 0.9)
    assert least >= 1 and tables < 100 and k > 10


def test_projection_join_blocks(spark, monkeypatch):
    monkeypatch.setattr(projection_join, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.05 * rng.standard_normal(16)).tolist()) for i in range(100)]
    got = projection_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["_component"] for r in got} == {0} and all(r["_n_links"] == 99 for r in got)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert projection_join.near_vectors(empty).count() == 0


def test_projection_join_keeps_links(spark):
    # a chain whose largest id stands in the middle, an exact cosine of 0.9, magnitudes whose squares leave double precision
    at = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(1, at(0)), (2, at(40)), (9, at(20)), (20, [0.0, 0.0, 1e200, 0.0]), (21, [0.0, 0.0, 1e-200, 0.0]), (30, [0.0] * 4),
            (40, [9.0, 3.0, 3.0, 1.0, 0.0]), (41, [7.0, 0.0, 0.0, 0.0, 0.0])]
    got = by_id(projection_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "_id")
    assert [(i, g["_n_links"], g["_component"]) for i, g in sorted(got.items())] == [
        (1, 1, 1), (2, 1, 1), (9, 2, 1), (20, 1, 20), (21, 1, 20), (30, 0, 30), (40, 1, 40), (41, 1, 40)]
    # pairs just above the threshold: each is found
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3_000):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.9001 * a + np.sqrt(1 - 0.9001**2) * b).tolist())]
    got = projection_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.where("_n_links = 1 and _component = _id - _id % 2").count() == 6_000


@pytest.mark.parametrize("window", [3, 20])
def test_substring_words(spark, plain, docs, window):
    sent, gone = brute.repeated_words(plain, window)
    got = by_id(substring_words.remove_repeated_windows(docs, window, digest=True))
    for i, s in sent.items():
        kept = b" ".join(w for w, g in zip(s, gone[i], strict=True) if not g)
        assert (got[i]["_n_words"], got[i]["_n_removed"], got[i]["_kept"]) == (len(s), sum(gone[i]), hashlib.sha256(kept).hexdigest()), i
    texts = by_id(substring_words.remove_repeated_windows(docs, window))
    assert texts[4]["_kept"] is None and texts[7]["_kept"] == "x" and texts[7]["part"] is not None
    assert substring_words.remove_repeated_windows(docs.where("1 = 0"), window).count() == 0


def test_pieces(spark, docs):
    p = piece_nbest.pieces_of(piece_nbest.default_model())

    def paths(unit, at=0):
        if at == len(unit):
            yield 0.0, ()
            return
        for end, score, ids in p.edges(unit, at):
            for s, rest in paths(unit, end):
                yield score + s, ids + rest

    for text in ["the cat", "naïve ☃", "a  b", "x\ny", "Hello"]:
        full = sorted((s for s, _ in paths(piece_nbest.MARK + text.replace(" ", piece_nbest.MARK))), reverse=True)[:4]
        got = p.nbest(text, 4)
        assert [round(s) for s, _ in got] == [round(s) for s in full]
        assert all(p.decode(i.tolist()) == text for _, i in got)
        assert len({tuple(i.tolist()) for _, i in got}) == len(got)
    rows = piece_nbest.encode_nbest(docs, piece_nbest.default_model(), 3).collect()
    for r in rows:
        assert r["_round"] and r["part"] is not None
        assert (r["_n_pieces"] == 0) == (not r["text"])
        assert r["_scores"] == sorted(r["_scores"], reverse=True)
    ids = piece_nbest.encode_nbest(docs, piece_nbest.default_model(), 1, form="best").select("doc_id", F.col("_ids").alias("ids"), "text")
    for r in piece_nbest.decode_ids(ids, piece_nbest.default_model()).collect():
        assert r["_text"] == (r["text"] or "")


def test_long_units_and_short_ones_agree(monkeypatch):
    p = piece_nbest.Pieces(piece_nbest.default_model())
    text = "internationalization of antidisestablishmentarianism"
    want = [s for s, _ in p.nbest(text, 3)]
    monkeypatch.setattr(piece_nbest, "VECTOR_LENGTH", 2)
    assert [s for s, _ in piece_nbest.Pieces(piece_nbest.default_model()).nbest(text, 3)] == want


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="home sidebar">
<nav><ul><li><a href=x>{m}</a><li>home</ul></nav><header><h1>Site</h1></header><div class="cookie notice">We use cookies {m}</div>
<article><h1>{t} &amp; more</h1><p>First <b>para{t}</b>graph<br>of&nbsp;{t}<p>Second   one {m}<ul><li>item {t}<li>item two</ul>
<div class="share">Share this</div><form><p>Mail</p><input></form><section id="comments"><p>nice {t}</p></section></article>
<aside>other {t}</aside><!-- ad --><div class="ad">Buy {t}</div><footer>&copy; {m}</footer></body></html>"""


def test_wrapper_induction(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(t=f"topic{i}", m=f"m{i * 7}"), "x", 1) for i in range(12)]
    rows += [(20, "http://h0.example.com/0", rows[0][2], "x", 1), (21, None, None, "x", 1), (22, "", "", "x", 1), (23, "http://h0.example.com/q", "plain text < 5", "x", 1),
             (24, "http://solo.example.com", "<article><p>alone<!-- open", "x", 1), (20, "http://h0.example.com/0", rows[0][2], "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, n int")
    got = by_id(wrapper_induction.extract(df), "page_id")
    for i in range(12):
        t, m = f"topic{i}", f"m{i * 7}"
        assert got[i]["_text"] == f"{t} & more\n\nFirst para{t}graph of {t}\n\nSecond one {m}\n\nitem {t}\n\nitem two", i
    assert got[20]["_text"] == got[0]["_text"] and got[21]["_text"] == got[22]["_text"] == ""
    assert got[23]["_text"] == "plain text < 5" and got[24]["_text"] == "alone" and got[24]["_n_chars"] == 5
    assert wrapper_induction.extract(df.where("1 = 0")).count() == 0


def test_constant_slots_are_template():
    html = "<body><div class=x><p>Welcome back, reader</p></div><div class=y><p>{}</p></div></body>"
    pages = [wrapper_induction.Tree(wrapper_induction.Page(html.format(f"story {i}")).pack()) for i in range(9)]
    assert wrapper_induction.induce(pages) == [[f"story {i}"] for i in range(9)]


@pytest.mark.parametrize("n", [2, 3, 4, 65])
def test_hosts_of_any_size_are_induced(spark, n):
    html = "<body><div class=x><p>Welcome back, reader</p></div><div class=y><p>story {}</p></div></body>"
    rows = [(i, f"http://one.example.com/{i}", html.format(i)) for i in range(n)]
    got = by_id(wrapper_induction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert {i: g["_text"] for i, g in got.items()} == {i: f"story {i}" for i in range(n)}


def test_copies_do_not_take_the_place_of_partners():
    html = "<body><div class=x><p>Welcome back, reader</p></div><div class=y><p>{}</p></div></body>"
    texts = ["copy"] * 6 + ["other"]
    pages = [wrapper_induction.Tree(wrapper_induction.Page(html.format(t)).pack()) for t in texts]
    assert wrapper_induction.induce(pages) == [[t] for t in texts]


def test_short_last_slices_join_the_one_before():
    import pyarrow as pa

    for sizes in ([65], [64, 1], [10] * 7, [64, 64, 4], [200], [3], [64, 7], []):
        batches, at = [], 0
        for k in sizes:
            batches.append(pa.record_batch([pa.array(range(at, at + k))], ["x"]))
            at += k
        parts = [b.column("x").to_pylist() for b in wrapper_induction._slices(iter(batches))]
        assert sum(parts, []) == list(range(at))
        assert all(len(p) >= min(at, wrapper_induction.SHORT) and len(p) < wrapper_induction.BATCH + wrapper_induction.SHORT for p in parts)


def test_pfair(spark, docs):
    quota = pfair_mix.quotas({"a": 5.0, "b": 3.0, "c": 1.0, None: 1.0}, 100)
    table = pfair_mix.one_period(quota)
    assert sum(quota.values()) == 100 == len(table)
    for s, e in quota.items():
        done = 0
        for slot in range(100):
            done += table[slot][0] == s
            assert abs(done - (slot + 1) * e / 100) < 1
    assert all(r <= slot < d for _, _, r, d, slot in table)
    got = pfair_mix.mix(docs, {"s0": 2.0, "s1": 1.0, "s2": 1.0, None: 1.0}, block_words=20).collect()
    assert len(got) == docs.count()
    assert all(r["_release"] <= r["_slot"] < r["_deadline"] for r in got)
    blocks = {(r["source"], r["_block"]): r["_slot"] for r in got}
    assert len(set(blocks.values())) == len(blocks)
    assert all(r["_slot"] is None for r in pfair_mix.mix(docs, {"s9": 1.0}).collect())
    assert pfair_mix.mix(docs.where("1 = 0")).count() == 0


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 2000.0**0.7, "b": 3000.0**0.7, "c": 5.0**0.7}])
def test_pfair_keeps_the_exact_weights_over_many_periods(spark, weights):
    sizes = {"a": 2000, "b": 3000, "c": 5}
    rows = [(10_000 * k + i, "word", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = pfair_mix.mix(df, weights, block_words=1, period=100).collect()
    assert len(got) == len(rows) == len({r["_slot"] for r in got})
    total = sum(Fraction(w) for w in weights.values())
    for s, n in sizes.items():
        share = Fraction(weights[s]) / total
        slots = sorted((r["_block"], r["_slot"], r["_release"], r["_deadline"]) for r in got if r["source"] == s)
        assert [x[0] for x in slots] == list(range(n))
        for j, slot, release, due in slots:
            assert (release, due) == (floor(j / share), ceil((j + 1) / share)) and release <= slot < due
            assert abs(j - slot * share) < 1 and abs(j + 1 - (slot + 1) * share) < 1


def test_pfair_takes_any_number_of_sources(spark):
    df = spark.createDataFrame([(i, "a few words", f"s{i % 1200}") for i in range(2400)], "doc_id long, text string, source string")
    got = pfair_mix.mix(df, {f"s{i}": 1.0 for i in range(1200)}, block_words=3).collect()
    assert sorted(r["_slot"] for r in got) == list(range(2400)) and all(r["_within"] for r in got if r["_block"] == 0)
    got = pfair_mix.mix(df, {f"s{i}": 1.0 + i / 7 for i in range(1200)}, block_words=3).collect()
    assert len({r["_slot"] for r in got}) == 2400 and all(r["_release"] <= r["_slot"] < r["_deadline"] for r in got)


def test_token_codes(spark, plain, docs, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_codes, "SHARD_TOKENS", 500)
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    folder = str(tmp_path / "ids")
    token_codes.write_ids(docs, path, folder)
    got = token_codes.read_documents(spark, folder).collect()
    t = Tokenizer.from_file(path)
    rows = sorted([*plain, plain[0]], key=lambda r: NULL if r[0] is None else r[0])
    want, at, stream = [], 0, []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
        stream += ids
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    places = list(range(0, at, 37)) + [at - 1]
    picked = {r["place"]: r["token"] for r in token_codes.read_tokens(spark, folder, spark.createDataFrame([(p,) for p in places], "place long")).collect()}
    assert picked == {p: stream[p] for p in places}
    for ids in ([], [0], [255, 256, 65_536, 70_000_000, 1] * 300):
        chunks, bits, ranks = token_codes.pack_levels(np.array(ids, np.uint32))
        assert token_codes.unpack_levels(chunks, bits).tolist() == ids
        assert [token_codes.token_at(chunks, bits, ranks, k) for k in range(0, len(ids), 101)] == ids[::101]
    token_codes.write_ids(docs.where("1 = 0"), path, str(tmp_path / "none"))
    assert token_codes.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_near_duplicates(spark, plain, docs):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(NULL if i is None else i, t) for i, t in plain]
    for g in range(4):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for k in range(25):
            s = list(base)
            for _ in range(rng.randint(0, 8)):
                s[rng.randrange(len(s))] = rng.choice(vocabulary)
            rows.append((100 + 100 * g + k, " ".join(s)))
    df = spark.createDataFrame([(None if i == NULL else i, t, 1) for i, t in rows] + [(1, plain[0][1], 2)], "doc_id long, text string, n int")
    for size in (4, 5):
        got = by_id(sketch_dedup.near_duplicates(df, size, 80), "_doc")
        sets, want = brute.near(rows, size, 80)
        assert {i: g["_component"] for i, g in got.items()} == want
        assert {i: g["_n_shingles"] for i, g in got.items()} == {i: len(s) for i, s in sets.items()}
    assert sketch_dedup.near_duplicates(df.where("1 = 0")).count() == 0


def test_joint_estimate_is_close():
    rng = np.random.default_rng(2)
    for overlap in (0.3, 0.8, 0.95):
        x = np.unique(rng.integers(0, 1 << 63, 4000, dtype=np.uint64))
        y = np.concatenate([x[: int(len(x) * overlap)], np.unique(rng.integers(0, 1 << 63, len(x) - int(len(x) * overlap), dtype=np.uint64))])
        y.sort()
        reg = sketch_dedup.registers_of(np.concatenate([x, y]), np.array([len(x), len(y)]))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        got = sketch_dedup.likely_jaccard(reg[:1], reg[1:], np.array([float(len(x))]), np.array([float(len(y))]))[0]
        assert abs(got - true) < sketch_dedup.MARGIN
        both = sketch_dedup.registers_of(np.union1d(x, y), np.array([len(np.union1d(x, y))]))
        assert (both[0] == np.maximum(reg[0], reg[1])).all()


def test_quality_rules(spark, docs):
    lines = [(100 + i, f"Unique text number {i} with enough different words " + " ".join(f"u{i}x{j}" for j in range(60)) + "\nAll rights reserved by the site", "web") for i in range(30)]
    lines += [(200 + i, "All rights reserved by the site\n" * 30 + f"tail {i}", "web") for i in range(3)]
    more = spark.createDataFrame(lines, "doc_id long, text string, source string")
    got = by_id(quality_rules.judge(docs.select("doc_id", "text", "source").union(more), with_text=True))
    assert got[100]["_n_removed_lines"] == 0 and got[101]["_n_removed_lines"] == 1 and got[101]["_kept"]
    assert got[101]["_text"].endswith("u1x59") and "reserved" not in got[101]["_text"]
    assert not got[201]["_kept"] and not got[4]["_kept"] and got[4]["_n_words"] == 0
    assert got[12]["_n_dup_lines"] == 1 and got[12]["_n_symbols"] == 8 and got[12]["_base_failed"]
    assert got[9]["_kept"] and got[1]["_n_repeat_words"] == 0 and got[15]["_n_repeat_words"] == got[15]["_n_words"]
    assert quality_rules.judge(docs.where("1 = 0")).count() == 0


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mixing", "encoding"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*columns).write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "encoding":
            assert out.columns == columns
            out.write.parquet(str(tmp_path / name))
            frame = spark.read.parquet(str(tmp_path / name))
    ids = {r["doc_id"] for r in frame.collect()}
    assert ids == {None, 9}  # the null id is the smallest of its group
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == ids and all(r["round_trip"] for r in rows)


def test_pipeline_judges_rows_that_share_an_id_by_their_own_texts(spark):
    import corpus_pipeline

    def text(k):
        return " ".join(f"t{k}w{j}" for j in range(60))

    rows = [(None, text(k)) for k in range(5)] + [(None, text(0)), (7, text(1) + " more"), (8, text(6)), (8, text(7)), (8, text(7)), (9, text(6) + " more"), (9, None), (9, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, df, "").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(None, text(k)) for k in range(5)} | {(8, text(6)), (8, text(7)), (9, None), (9, "")}


def test_pipeline_rows_keep_the_mixture(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    sizes = {"a": 24, "b": 12, "c": 4}
    sources = [s for s, n in sizes.items() for _ in range(n)]
    rows = [(i, f"t{i} " + "the cat " * 4999 + "end", "en", s, 40_000) for i, s in enumerate(sources)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    slots = {r["doc_id"]: (r["_slot"], r["_within"]) for r in pfair_mix.mix(df, temper=corpus_pipeline.TEMPER).collect()}
    found = []
    for stages in (corpus_pipeline.STAGES[-2:], corpus_pipeline.STAGES[-1:]):
        monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
        got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r["mix_position"])
        assert len({r["mix_position"] for r in got}) == len(rows)
        found.append([r["doc_id"] for r in got])
    assert found[0] == sorted(slots, key=slots.get)
    assert found[1] == list(range(len(rows)))  # without the stage, the order of the input
    within = [i for i in found[0] if slots[i][1]]
    total = sum(n**corpus_pipeline.TEMPER for n in sizes.values())
    assert len(within) > 10
    for s, n in sizes.items():
        for k in range(len(within) + 1):
            assert abs(sum(sources[i] == s for i in within[:k]) - k * n**corpus_pipeline.TEMPER / total) < 1
