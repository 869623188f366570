"""Token store and packing: exact round trips against the whole tokenizer."""

import json
import zlib

import numpy as np
import pytest

from tracewarden.llm import packing, token_store
from tracewarden.llm.catalog import vocabulary_path
from tracewarden.llm.word_bpe import WordIds

TEXTS = [
    "The quick brown fox, jumps over the lazy dog.", "", None, "Élève ÜBER straße niño İstanbul ΟΔΟΣ e\u0301tude 中文 123 don't we'll '' ...", "a\x1cb c", "<|endoftext|> x<|startoftext|>y",
    "tab\tnew\nline\u2003wide\u00a0hard", "long " * 30_000, "The quick brown fox, jumps over the lazy dog.", "ªº ǅ ﬁ ½ x² \u0301start", "\x00 nul",
]


@pytest.fixture(scope="module")
def ids():
    words = WordIds(vocabulary_path())
    return {t: np.frombuffer(words.whole(t or ""), "<u4") for t in TEXTS}


def test_words_give_the_ids_of_the_whole_text(ids):
    words = WordIds(vocabulary_path())
    for text in TEXTS:
        assert words.encode(text) == ids[text].tobytes(), text


def other_rules(tmp_path):
    """The vocabulary file without lower-casing: words are then no longer what the quick way takes them for."""
    rules = json.loads(open(vocabulary_path(), encoding="utf-8").read())
    rules["normalizer"]["normalizers"] = rules["normalizer"]["normalizers"][:2]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    return str(path)


def test_other_rules_go_through_the_whole_encoder(tmp_path):
    words = WordIds(other_rules(tmp_path))
    assert WordIds(vocabulary_path()).by_word and not words.by_word
    for text in TEXTS[:6]:
        assert words.encode(text) == words.whole(text or "")


def test_marks_after_letters_are_encoded_once_for_all_words(monkeypatch):
    words, calls = WordIds(vocabulary_path()), []
    whole = words.whole
    monkeypatch.setattr(words, "whole", lambda text: calls.append(text) or whole(text))
    text = " ".join(f"{stem}{marks}" for marks in ("&&&", "!!", ".%%%", "_", ",***", "|>", "\\") for stem in ("Fox", "ÜBER", "ΟΔΟΣ", "中文"))
    assert words.encode(text) == whole(text)
    assert sorted(calls) == sorted({"&&&", "!!", ".%%%", "_", ",***", "|>", "\\"})
    for odd in ("İs!!", "e\u0301&&", "fox&&'s", "fox'&&", "fox'", "a''b!", "9!!", "x9!!", "'ll!!", "<|endoftext|>!!", "fox<|endoftext|>", "fox\u0301!", "!!\u0301"):
        assert words.encode(odd) == whole(odd), odd


def test_added_tokens_of_letters_go_through_the_whole_encoder(tmp_path):
    rules = json.loads(open(vocabulary_path(), encoding="utf-8").read())
    rules["added_tokens"].append({"id": 49_408, "content": "fox&", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    path = tmp_path / "letters.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    words = WordIds(str(path))
    assert not words.by_word and words.encode("a fox&& runs") == words.whole("a fox&& runs")


def test_large_ids_are_stored_whole(spark, tmp_path):
    rules = json.loads(open(vocabulary_path(), encoding="utf-8").read())
    rules["added_tokens"].append({"id": 70_000, "content": "<|far|>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    rules["model"]["vocab"]["<|far|>"] = 70_000
    path = tmp_path / "far.json"
    path.write_text(json.dumps(rules), encoding="utf-8")
    folder = token_store.write_store(frame(spark, [(1, "one <|far|> two")]), str(tmp_path / "far"), str(path), 1)
    assert 70_000 in token_store.fetch(spark, folder, [1]).first().ids
    assert spark.read.parquet(f"{folder}/dictionary").first().bytes_per_id == 4
    folder = token_store.write_store(frame(spark, [(1, "one")]), str(tmp_path / "end"), vocabulary_path(), 90_000)
    assert token_store.fetch(spark, folder, [1]).first().ids[-1] == 90_000


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, ids string")


def test_store_round_trip(spark, tmp_path, ids):
    rows = [(10 * i % 97, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (20, TEXTS[0])]
    folder = token_store.write_store(frame(spark, rows), str(tmp_path / "store"), vocabulary_path(), 1)
    got = token_store.read_digests(spark, folder).toPandas().sort_values("start")
    assert len(got) == len(rows)
    known = got.doc_id.tolist()
    assert np.isnan(known[0]) and known[1:] == sorted(known[1:])
    assert got.start.tolist() == np.concatenate([[0], np.cumsum(got.n_tokens)[:-1]]).tolist()
    words = WordIds(vocabulary_path())
    want = sorted((-1 if i is None else i, len(a), zlib.crc32(a)) for i, a in ((i, words.encode(t) + np.array([1], "<u4").tobytes()) for i, t in rows))
    assert sorted((-1 if np.isnan(r.doc_id) else int(r.doc_id), 4 * r.n_tokens, r.ids_crc32) for r in got.itertuples()) == want
    few = {r.doc_id: r.ids for r in token_store.fetch(spark, folder, [10, 30, 5000]).collect()}
    assert few == {10: [1], 30: ids[TEXTS[3]].tolist() + [1]}
    dictionary = spark.read.parquet(f"{folder}/dictionary").first()
    assert spark.read.parquet(f"{folder}/blocks").select("dict_hash").distinct().collect()[0][0] == dictionary.dict_hash


def test_store_of_nothing(spark, tmp_path):
    folder = token_store.write_store(frame(spark, [(1, "x")]).limit(0), str(tmp_path / "none"), vocabulary_path(), 1)
    assert token_store.read_digests(spark, folder).count() == 0


def test_trained_dictionary_is_used(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"word{x}" for x in rng.integers(0, 50, 40))) for i in range(400)]
    folder = token_store.write_store(frame(spark, rows), str(tmp_path / "trained"), vocabulary_path(), 1)
    assert len(spark.read.parquet(f"{folder}/dictionary").first().dictionary) > 1000
    assert token_store.read_digests(spark, folder).count() == 400


def check_pieces(pieces, lengths, capacity):
    """Every id once, offsets without gaps; gives the padding."""
    at = {}
    for p in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert p[1] == at.get(p[0], 0)
        at[p[0]] = p[1] + p[2]
    assert at == {i: n for i, n in enumerate(lengths) if n}
    fill = {}
    for p in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert p[4] == fill.get(p[3], 0)
        fill[p[3]] = p[4] + p[2]
    assert max(fill.values(), default=0) <= capacity
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in fill.values())


def test_first_fit_decreasing_is_exact():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 200):
        lengths = rng.integers(1, 101, n).tolist()
        free, want = [], {}
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            slot = next((b for b, room in enumerate(free) if room >= lengths[i]), None)
            if slot is None:
                free.append(100)
                slot = len(free) - 1
            free[slot] -= lengths[i]
            want[i] = slot
        assert packing.first_fit_decreasing(lengths, 100) == [want[i] for i in range(n)]


def test_groups_have_little_padding():
    rng = np.random.default_rng(2)
    for lengths in ([], [1], [4096], [4097], [12_288], rng.integers(1, 30_000, 300).tolist(), rng.integers(1, 900, 2000).tolist(), [4095] * 50, [2049] * 40):
        padding = check_pieces(packing.pack_group(lengths, 4096), lengths, 4096)
        assert padding <= 0.03 * sum(lengths) + 4


def test_packing_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (0, TEXTS[0]), (None, "no id"), (None, None)]
    out = packing.pack(frame(spark, rows), vocabulary_path(), 2).toPandas()
    words, end = WordIds(vocabulary_path()), np.array([2], "<u4").tobytes()
    whole = {}
    for r in out.sort_values(["sequence_id", "offset"]).itertuples():
        assert len(r.ids) == 4 * r.length and r.length > 0
    for key, own in out[out.doc_id.notna() & (out.doc_id != 0)].sort_values("start").groupby("doc_id"):
        whole[int(key)] = b"".join(own.ids)
    assert whole == {i: words.encode(t) + end for i, t in rows if i}
    repeated = out[out.doc_id == 0]
    assert sum(repeated.length) == 3 * len(words.encode(TEXTS[0]) + end) // 4
    fill = out.groupby("sequence_id").apply(lambda g: (g.length.sum(), g.offset.min(), g.offset.max() + g.sort_values("offset").length.iloc[-1]), include_groups=False)
    assert all(total == top and low == 0 and total <= 4096 for total, low, top in fill)
    assert packing.pack(frame(spark, rows).limit(0), vocabulary_path(), 2).count() == 0
