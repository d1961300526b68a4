"""Log probabilities of pieces: counts against the model's own encoding, search against all segmentations."""

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from compoundry.llm import piece_nbest

TEXTS = ["the international organization of the country", "a  b   c \n\n  d ", " lead", "\ttab\nline", "naïve ☃ 語", "", None, "the the the", "x" * 3000,
         "the international organization of the country"]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, _ids string").repartition(3)


@pytest.fixture(scope="module")
def path():
    return piece_nbest.default_model()


def test_counts_are_those_of_the_models_own_encoding(table, path, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = np.bincount([i for t in TEXTS if t for i in model.encode(t)], minlength=model.get_piece_size())
    got = {r["id"]: r["n"] for r in piece_nbest.piece_counts(table, path).collect()}
    assert got == {int(i): int(want[i]) for i in np.flatnonzero(want)}
    own = piece_nbest.OwnPieces(path)
    monkeypatch.setattr(piece_nbest, "COUNTED_UNITS", 2)
    monkeypatch.setattr(piece_nbest, "CACHE_UNITS", 1)
    for t in TEXTS:
        own.add(t) if t else None
    own.settle()
    assert (own.counts == want).all()


def test_weights_without_text_are_equal(table, path):
    w = np.frombuffer(piece_nbest.piece_weights(table.where("text is null"), path))
    assert len(set(w.tolist())) == 1 and np.exp(w).sum() == pytest.approx(1)
    empty = piece_nbest.encode_nbest(table.where("1 = 0"), path, 2, weights=w.tobytes())
    assert empty.count() == 0 and empty.columns[-4:] == ["_n_pieces", "_scores", "_ids", "_round"]


def test_best_paths_by_weights(table, path):
    p = piece_nbest.pieces_of(path, piece_nbest.piece_weights(table, path))

    def paths(unit, at=0):
        if at == len(unit):
            yield 0.0
            return
        for end, score, _ in p.edges(unit, at):
            for s in paths(unit, end):
                yield score + s

    for text in ("the cat", "naïve ☃", "a  b", "x\ny", "country"):
        want = sorted(paths(piece_nbest.MARK + text.replace(" ", piece_nbest.MARK)), reverse=True)[:4]
        assert [s for s, _ in p.nbest(text, 4)] == pytest.approx(want)


def test_rows_by_weights(spark, table, path):
    docs = table.drop("_ids")
    rows = piece_nbest.encode_nbest(docs, path, 3, weights=piece_nbest.piece_weights(docs, path)).orderBy("doc_id").collect()
    assert [r["_round"] for r in rows] == [True] * len(TEXTS)
    assert rows[0]["_ids"] == rows[9]["_ids"] and rows[5]["_ids"] == rows[6]["_ids"] == []
    assert all(r["_scores"] == sorted(r["_scores"], reverse=True) and all(s < 0 for s in r["_scores"]) for r in rows)


def test_as_many_pieces_as_the_model(spark, path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") > 0)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [model.encode(r["text"]) for r in docs.select("text").orderBy("doc_id", "text").collect()]
    got = piece_nbest.encode_nbest(docs, path, 1, form="best", weights=piece_nbest.piece_weights(docs, path))
    n = got.agg(F.sum("_n_pieces")).first()[0]
    assert abs(n / sum(map(len, own)) - 1) < 0.05


def test_lookups_end_where_no_piece_goes_on(path, monkeypatch):
    p = piece_nbest.Pieces(path)
    asked = []
    monkeypatch.setattr(p, "find", lambda h, find=p.find: (asked.append(len(h)), find(h))[1])
    words = ["".join(chr(97 + (7 * i + 5 * j * j) % 26) for j in range(20)) for i in range(26)]
    got = p.encode([" ".join(words)], 2)[0]
    every = 26 * sum(min(p.longest, 21 - i) for i in range(21))
    assert sum(asked) < every / 2
    assert p.decode(got[0][1].tolist()) == " ".join(words) and got[0][0] >= got[1][0]


def test_fallback_bytes_of_units_met_again(path):
    p = piece_nbest.Pieces(path)
    text = "\U0001f9ff\x01 ꙮx \U0001f9ff\x01 ꙮx ߷"
    got = p.encode([text, text[::-1]], 3)
    for t, lists in zip((text, text[::-1]), got, strict=True):
        assert all(p.decode(i.tolist()) == t for _, i in lists)
