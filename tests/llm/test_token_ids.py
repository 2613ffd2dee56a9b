"""Ops 2, 5 and 8 against the tokenizers library."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe_tree, packing, repair
from tidemark.llm.bpe import Encoder, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
PARTS = [
    "a", "the", "ing", "'", "'s", "'ll", " ", "  ", "\n", "\n\n", "é", "ß", "你", "好", "12", "3", "!", "..", "…", "\t",
    "\x1c", "　", "᠎", "𝔘", "<|", "qqqqq", "😀", "́", " the", " a", "Σ", "İ", "\xa0", "²",
]


def library(path):
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path):
    rng, enc, tok = random.Random(3), Encoder(path), library(path)
    for _ in range(1500):
        text = "".join(rng.choices([*PARTS, "<|endoftext|>"], k=rng.randint(0, 40)))
        assert enc.ids(enc.encode(text)).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_halves_join_to_the_whole():
    rng, enc, tok = random.Random(4), Encoder(BYTE), library(BYTE)
    for k in range(1500):
        pool = PARTS if k % 2 else ["a", "b", "ing", "th", "e", "n", "tion"]
        pool = rng.choices(PARTS, k=2) if k % 5 == 0 else pool
        text, size = "".join(rng.choices(pool, k=rng.randint(0, 90))), rng.randint(2, 20)
        parts = [enc.ids(enc.encode(text[i : i + size])) for i in range(0, len(text), size)]
        assert enc.join_all(parts).tolist() == tok.encode(text, add_special_tokens=False).ids, text


def want_digest(rows):
    tok, out = library(BYTE), Counter()
    for doc_id, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[doc_id, len(ids), sha(",".join(map(str, ids))), sha(back)] += 1
    return out


def test_op2(spark, odd_docs, no_docs, some_docs, folder_of):
    for docs in (odd_docs, some_docs, no_docs):
        got = bpe_tree.op2_bpe_tree(spark, folder_of(documents=docs))
        want = want_digest([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert Counter(map(tuple, got.collect())) == want
        assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_small_leaves_and_decoding(some_docs, odd_docs):
    docs = some_docs.limit(30).select("doc_id", "text").union(odd_docs.select("doc_id", "text").where("doc_id > 6"))
    encoded = bpe_tree.encode(docs, BYTE, leaf_chars=37)
    texts = bpe_tree.decode(encoded, BYTE)
    assert sorted(map(tuple, texts.collect())) == sorted((r.doc_id, r.text or "") for r in docs.collect())


def check_packing(docs, rows, tokens, segments, loss):
    tok, pieces, bins, whole = library(BYTE), defaultdict(list), defaultdict(list), Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = (*tok.encode(r.text or "", add_special_tokens=False).ids, 1)
        whole[r.doc_id, ids] += 1
    for r in rows:
        bins[r.sequence_id].append(r)
        pieces[r.doc_id, r.doc_tokens].append(r)
    for r in bins.values():
        r.sort(key=lambda x: x.offset)
        assert [x.offset for x in r] == np.cumsum([0, *(x.length for x in r)])[:-1].tolist()
        assert sum(x.length for x in r) <= tokens and len(r) <= segments and sum(x.loss_tokens for x in r) <= loss
    left = Counter(whole)
    for (doc_id, ids), n in whole.items():
        parts = sorted(pieces[doc_id, len(ids)], key=lambda r: r.start)
        assert all(r.length > 0 for r in parts)
        own = [r for r in parts if r.ids_crc32 == crc(ids[r.start : r.start + r.length])]
        cover = Counter(i for r in own for i in range(r.start, r.start + r.length))
        assert all(cover[i] >= n for i in range(len(ids)))
        left[doc_id, ids] = 0
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in whole.items())
    return bins


def test_op5(spark, odd_docs, no_docs, some_docs, folder_of):
    for docs in (odd_docs, some_docs, no_docs):
        got = packing.op5_vector_packing(spark, folder_of(documents=docs)).collect()
        check_packing(docs, got, 2048, 1024, 1536)
    assert got == []


def test_packing_leaves_little_padding(spark, some_docs):
    many = some_docs.select("doc_id", "text").coalesce(1)
    one_word = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text")).coalesce(1)
    long_text = some_docs.agg(F.lit(0).cast("long").alias("doc_id"), F.concat_ws(" ", F.collect_list("text")).alias("text"))
    for docs, not_full in ((many, 2), (one_word, 1), (many.union(long_text).coalesce(1), 2)):
        rows = packing.pack(docs, BYTE, loss=1536, loss_from=0.5).collect()
        bins = check_packing(docs, rows, 2048, 1024, 1536)
        assert sum(sum(r.length for r in b) < 2048 for b in bins.values()) <= not_full
        for r in rows:
            first = int(0.5 * r.doc_tokens)
            assert r.loss_tokens == max(0, r.start + r.length - max(r.start, first))


def test_loss_limit_binds(some_docs):
    """Sequences that go beyond the loss limit where there is none keep to it where there is."""
    most = {}
    for loss in (2048, 1100):
        rows = packing.pack(some_docs.coalesce(1), BYTE, loss=loss, loss_from=0.5).collect()
        bins = check_packing(some_docs, rows, 2048, 1024, loss)
        most[loss] = max(sum(r.loss_tokens for r in b) for b in bins.values())
        assert sum(sum(r.length for r in b) < 2048 for b in bins.values()) <= 2
    assert most[2048] > 1100


def test_all_limits_bind(spark, some_docs):
    docs = some_docs.limit(60).withColumn("lead", some_docs.text.substr(1, 200))
    rows = packing.pack(docs, BYTE, tokens=512, segments=3, loss=300, pool=16, prompt="lead").collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    for b in bins.values():
        assert sum(r.length for r in b) <= 512 and len(b) <= 3 and sum(r.loss_tokens for r in b) <= 300
    tok = library(BYTE)
    lead = {r.doc_id: len(tok.encode(r.lead, add_special_tokens=False).ids) for r in docs.collect()}
    loss = Counter()
    for r in rows:
        loss[r.doc_id] += r.loss_tokens
    assert all(loss[d] == r.doc_tokens - lead[d] for d, r in {r.doc_id: r for r in rows}.items())


def test_op8(spark, odd_docs, no_docs, some_docs, folder_of):
    tok = library(WORD)
    for docs in (odd_docs, some_docs, no_docs):
        got = repair.op8_repair_ids(spark, folder_of(documents=docs.repartition(3))).collect()
        got.sort(key=lambda r: r.start)
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
            want[r.doc_id, len(ids), crc(ids)] += 1
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
        ids = [r.doc_id for r in got]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_grammar_round_trip():
    rng = np.random.default_rng(5)
    for n, kinds in ((0, 3), (1, 3), (2, 1), (50, 1), (5000, 2), (5000, 40), (20_000, 400)):
        ids = rng.integers(0, kinds, n).astype(np.uint16)
        seq, rules = repair.compress(ids, 500)
        lengths = repair.rule_lengths(rules, 500)
        assert repair.expand(seq, rules, 500).tolist() == ids.tolist()
        row = {"terminals": 500, "rules": rules.tobytes(), "rule_ids": lengths.tobytes(), "sequence": seq.astype("<u4").tobytes()}
        block = repair.Block(row)
        if kinds == 2:
            assert len(seq) < n / 4
        for _ in range(20 if n else 0):
            a = int(rng.integers(0, n))
            k = int(rng.integers(1, n - a + 1))
            assert block.read_range(a, k).tolist() == ids[a : a + k].tolist()


def test_grammar_of_runs():
    for n in (4000, 4001, 100_000):
        for ids in (np.full(n, 7), np.tile([1, 2, 3], n), np.concatenate([np.full(n, 7), np.full(n, 8), np.full(n, 7)])):
            seq, rules = repair.compress(ids.astype(np.uint16), 500)
            lengths = repair.rule_lengths(rules, 500)
            assert repair.expand(seq, rules, 500).tolist() == ids.tolist()
            assert len(seq) + len(rules) < 120
            assert len({tuple(r) for r in rules.tolist()}) == len(rules)


def test_words_are_remembered_and_long_ones_go(monkeypatch):
    from tidemark.llm import bpe

    enc = bpe.Encoder(bpe.vocabulary("word_bpe_49k.json"))
    text = "It's 1984, it's Don'T!! cafés\v" + "x" * 60 + " x’s 'tis\r\n"
    assert enc.encode(text) == enc.library(text)
    monkeypatch.setattr(enc, "_model", None)  # nothing is merged again
    known = "don't IT'S 1984, 1984,\t'tis"
    assert enc.encode(known) == enc.library(known)
    assert all(len(w) <= bpe.MEMO_CHARS for memo in (enc._memo, enc._words) for w in memo)
    assert "it's" in enc._words and "1984," in enc._words


def test_words_of_one_piece_are_remembered_once():
    from tidemark.llm import bpe

    enc = bpe.Encoder(bpe.vocabulary("word_bpe_49k.json"))
    text = "alpha Beta 'gamma' 12 alpha --' 's don't été,"
    assert enc.encode(text) == enc.library(text)
    met = {"alpha", "beta", "'gamma'", "'", "gamma", "12", "1", "2", "--'", "'s", "don't", "don", "'t", "été,", "été", ","}
    assert set(enc._memo) == met


def test_words_met_lately_are_not_merged_again(monkeypatch):
    from tidemark.llm import bpe

    monkeypatch.setattr(bpe, "MEMO_PIECES", 8)
    enc = bpe.Encoder(bpe.vocabulary("word_bpe_49k.json"))
    merged, merge = [], enc._merge_model
    enc._merge_model = lambda piece: merged.append(piece) or merge(piece)
    texts = ["one two three four five", "one two", "six seven eight nine ten", "one two"]
    assert [enc.encode(t) for t in texts] == [enc.library(t) for t in texts]
    assert merged.count("one") == merged.count("two") == 1
    enc.forget()
    assert not enc._memo and not enc._memo._before


@pytest.mark.parametrize("ids", [[7] * 300, [1, 2, 3] * 50, [5], [4, 4, 4, 9, 4, 4, 9, 4, 4, 9, 4, 4, 9]])
def test_expanding_by_rules_is_expanding_level_by_level(ids):
    seq, rules = repair.compress(np.array(ids * 3), 100)
    for part in (seq, np.concatenate([seq] * 400)):
        found = repair.expand(part, rules, 100)
        assert np.array_equal(found, repair._level_by_level(part, rules, 100)) and found.dtype == part.dtype
    assert repair.expand(seq, rules, 100).tolist() == ids * 3


def test_pairs_too_wide_for_one_number_are_sorted_alike():
    rng = np.random.default_rng(3)
    left, right = rng.integers(0, 50, (2, 500), dtype=np.uint32)
    for wide in (0, 1 << 31):
        pairs, order = repair._sorted_pairs(left + np.uint32(wide), right + np.uint32(wide))
        want = ((left.astype(np.int64) + wide) << 32) | (right.astype(np.int64) + wide)
        assert (np.diff(pairs) >= 0).all() and np.array_equal(want[order], pairs)
        assert np.array_equal(np.sort(order), np.arange(500))
