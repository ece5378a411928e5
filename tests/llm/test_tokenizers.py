import hashlib
import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from castline.llm import bpe_automaton, packing, queries
from castline.llm.bpe_automaton import Automaton, encode_texts
from castline.llm.byte_pairs import Vocabulary
from castline.llm.common import BATCH_BYTES, Memo, small_batches
from castline.llm.packing import Encoder, SumOfSquares, pack_documents, placed, plan_of
from castline.llm.parts import TOGETHER, slices
from castline.llm.token_counts import count_tokens, count_word

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a  b", " x", "x \n y", "don't we'll\t\n ok <|endoftext|>y <|endoftext|>", "日本語 テスト 🎉🎉", "12345 67½ ²", "İstanbul K ..., a.b,c.", "é ́a", "aaaaaaaa" * 50, "word " * 5000, "Ado&&& osadoraja***", "\x1c \x85 x"]


def texts(seed=7, n=300):
    rng = random.Random(seed)
    pieces = ["a", "T", "h", " ", "e", "iN", "g", "1", "é", "\n", "<|endoftext|>", " the", "s", "'s", ".", ",", "日", "　", "ß", "É", "zz"]
    return ODD + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "no id", "x", 1), (3, "a  b", "x", 1), (3, "a  b", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_encoding_equals_the_library(docs):
    library = Tokenizer.from_file(BYTE)
    rows = encode_texts(docs, BYTE).collect()
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        want = library.encode(known[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False) == known[r.doc_id]


def test_digests_and_counts(spark, docs, tmp_path):
    library = Tokenizer.from_file(BYTE)
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op2_bpe_roundtrip(spark, str(tmp_path)).collect():
        want = library.encode(known[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(known[r.doc_id].encode()).hexdigest()
    for r in count_tokens(docs, BYTE, 20).collect():
        n = len(library.encode(known[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(known[r.doc_id].encode()), n > 20)


def test_no_documents(docs):
    none = docs.limit(0)
    assert encode_texts(none, BYTE).count() == count_tokens(none, BYTE).count() == pack_documents(none, WORD).count() == 0


def merged(word, merges):
    """Merging by definition: the lowest-ranked pair, leftmost first, again and again."""
    word = list(word)
    while True:
        found = [(merges[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in merges]
        if not found:
            return word
        i = min(found)[1]
        word[i : i + 2] = [merges[word[i], word[i + 1]][1]]


def test_automaton_and_heap_on_random_merges():
    rng = random.Random(2)
    for _ in range(60):
        labels, merges = [b"a", b"b", b"c"], {}
        for rank in range(rng.randint(1, 14)):
            pair = rng.randrange(len(labels)), rng.randrange(len(labels))
            made = labels[pair[0]] + labels[pair[1]]
            if pair not in merges and made not in labels:
                merges[pair] = (rank, len(labels))
                labels.append(made)
        vocabulary = Vocabulary(labels, merges, [{97: 0, 98: 1, 99: 2}.get(b, 0) for b in range(256)], {})
        automaton = Automaton(vocabulary)
        words = [bytes(rng.choice(b"abc") for _ in range(600 if k % 30 == 0 else rng.randint(1, 14))) for k in range(60)]
        for word, ids in zip(words, automaton.encode_words(words)):
            want = merged([vocabulary.single[b] for b in word], merges)
            assert np.frombuffer(ids, np.int32).tolist() == want
            assert list(automaton.encode_word(word)) == want
            assert count_word(word, vocabulary) == len(want)
            assert automaton.decode(np.array(want), np.array([0, len(want)]))[0].tobytes() == word


def test_packing(docs):
    library = Tokenizer.from_file(WORD)
    rows = pack_documents(docs, WORD, size=64, keep_ids=True).toPandas()
    known = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows.drop_duplicates(["doc_id", "piece", "sequence_id", "offset"])) == len(rows)
    for r in rows.itertuples():
        ids = [*library.encode(known[None if r.doc_id != r.doc_id else r.doc_id], add_special_tokens=False).ids, 0]
        own = ids[r.start : r.start + r.length]
        assert r.start == 64 * r.piece and r.length == len(own) == min(64, len(ids) - r.start)
        assert list(r.ids) == own and r.ids_crc32 == zlib.crc32(np.asarray(own, "<u4").tobytes())
    total = 0
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"].to_numpy() == np.concatenate([[0], own["length"].cumsum().to_numpy()[:-1]])).all()
        assert own["length"].sum() <= 64
        total += 1
    assert total <= 1.1 * -(-rows["length"].sum() // 64) + 1


def test_words_equal_the_library():
    """All letters whose lower case has another length, marks, and letters about them, with signs after or before."""
    library, rng = Tokenizer.from_file(WORD), random.Random(11)
    odd = [chr(c) for c in range(0x250) if chr(c).isalpha() and not chr(c).isascii()] + [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).lower()) != 1] + list("\u0307\u0301\u0345ΣσςΆή日本ẞßﬁ")
    signs = ["", ".", ",", "!?", "...", "_", "1", "\u0307", " ", "\n", "'s"]
    rows = ["TÜRKİYE TATİLİ. SON", "İ.", "ABİ!", "KİŞİSİ, ADİ", "İİ İ", "ΣΑΣ. ΣΑΣ,", "x" * 70 + "İ.", "y" * 100 + "!"]
    rows += ["".join(rng.choice(odd) if rng.random() < 0.4 else rng.choice("abIiS") for _ in range(rng.randint(1, 5))) + rng.choice(signs) + " " + rng.choice(odd) + rng.choice(signs) for _ in range(6000)]
    rows += [c + s for c in odd for s in (".", "a.")]
    coder = Encoder(WORD)
    for start in range(0, len(rows), 2500):
        own = rows[start : start + 2500]
        ids, bounds = coder.encode(pa.array(own))
        for text, a, b in zip(own, bounds, bounds[1:]):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_memos_keep_short_keys_only():
    memo = Memo(len, 4)
    assert memo["x" * 65] == 65 and not memo
    for i in range(20):
        assert memo[str(i)] == len(str(i)) and len(memo) <= 4 and len(memo.old) <= 4


def test_memo_gives_many_values_at_once():
    memo = Memo(len, 4)
    memo.keep({"a": 1, "bb": 2, "ccc": 3})
    memo.keep({"dd": 2, "ee": 2})
    assert memo.old.keys() == {"a", "bb", "ccc"}
    assert memo.known(["bb", "z", "ee", "bb", "y" * 65]) == [2, None, 2, 2, None]
    assert "bb" in memo and "z" not in memo and len(memo) <= 4


def test_known_words_are_not_looked_up_one_by_one(monkeypatch):
    """Words of a slice that the one before had are found without a call for each."""
    coder, calls = Encoder(WORD), []
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    before = coder.encode(pa.array([" ".join(words)]))[0].tolist()
    for name in ("knows", "__missing__"):
        monkeypatch.setattr(Memo, name, lambda self, key, f=getattr(Memo, name): calls.append(key) or f(self, key))
    assert coder.encode(pa.array([" ".join(words)]))[0].tolist() == before
    assert before == Tokenizer.from_file(WORD).encode(" ".join(words), add_special_tokens=False).ids
    assert not calls


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["x" * n if n is not None else None for n in (0, TOGETHER, 5, None, TOGETHER + 9, 1)])], names=["i", "text"])
    assert [x.column(0).to_pylist() for x in slices(batch, 1)] == [[0, 1], [2, 3], [4], [5]]
    assert list(slices(batch.slice(0, 0), 1)) == []


def test_packing_many_parts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', cast(pmod(hash(id), 1500) as int))").alias("text")).repartition(70)
    rows = pack_documents(docs, WORD).toPandas()
    assert rows.doc_id.nunique() == 3000
    assert rows.sequence_id.nunique() <= 1.02 * -(-rows.length.sum() // 2048) + 1


def test_packing_of_complementary_tasks(spark):
    words = F.when(F.col("id") < 6000, 33 + F.col("id") % 3).otherwise(25 + F.col("id") % 3).cast("int")
    docs = spark.range(0, 12000, 1, 2).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), words).alias("text"))
    rows = pack_documents(docs, WORD, size=64).toPandas()
    assert rows.doc_id.nunique() == len(rows) == 12000
    own = rows.sort_values(["sequence_id", "offset"])
    assert (own.offset == own.groupby("sequence_id").length.cumsum() - own.length).all()
    assert own.groupby("sequence_id").length.sum().max() <= 64
    assert rows.sequence_id.nunique() == 6000


def test_plan_equals_best_fit():
    rng = random.Random(6)
    for _ in range(40):
        size = rng.randint(5, 60)
        lengths = sorted((rng.randint(1, size - 1) for _ in range(rng.randint(1, 300))), reverse=True)
        gaps = []
        for n in lengths:
            best = min((g for g in gaps if g >= n), default=None)
            if best is not None:
                gaps.remove(best)
            gaps.append((size if best is None else best) - n)
        made, plan = plan_of({n: lengths.count(n) for n in lengths}, size)
        assert made == len(gaps)
        nth = np.array([lengths[:i].count(n) for i, n in enumerate(lengths)])
        taken = np.zeros((made, size), int)
        for n, sequence, offset in zip(lengths, *placed(plan, np.array(lengths), nth)):
            taken[sequence, offset : offset + n] += 1
            assert offset + n <= size
        assert taken.max() == 1 and taken.sum() == sum(lengths)
        assert sorted(size - taken.sum(axis=1)) == sorted(gaps)


def test_sum_of_squares_places_where_squares_are_least():
    rng = random.Random(4)
    packer, fill = SumOfSquares(12), {}
    for _ in range(300):
        n = rng.randint(1, 12)
        counts = packer.counts[1:12].copy()
        options = []
        for gap in [g for g in range(n, 12) if counts[g - 1]] + [12]:
            after = counts.copy()
            if gap < 12:
                after[gap - 1] -= 1
            if gap > n:
                after[gap - n - 1] += 1
            options.append((after**2).sum())
        sequence, offset, left = packer.place(n)
        assert (packer.counts[1:12] ** 2).sum() == min(options)
        assert offset == fill.get(sequence, 0) and left == 12 - offset - n
        fill[sequence] = offset + n


def test_memo_holds_words_without_their_signs():
    coder = Encoder(WORD)
    texts = ["Straße, straße! STRASSE? « x »", "de&&& De### de, İd. ǅa-b Σς 가_"]
    ids, bounds = coder.encode(pa.array(texts))
    library = Tokenizer.from_file(WORD)
    assert [ids[a:b].tolist() for a, b in pairwise(bounds)] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert coder.words.knows("de") and not any(coder.parts.knows(x) for x in ("de&&&", "De###", "de,"))


def test_no_words_stay_in_a_worker_after_its_task(spark):
    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(memo()) + len(memo().old) for memo in Memo.made if memo() is not None)])], names=["n"])

    docs = spark.range(0, 2000, 1, 4).select(F.col("id").alias("doc_id"), F.expr("concat('word ', translate(cast(id as string), '0123456789', 'abcdefghij'))").alias("text"))
    assert pack_documents(docs, WORD).count() == 2000
    assert spark.range(0, 16, 1, 16).mapInArrow(kept, "n long").agg(F.max("n")).first()[0] == 0


def test_packing_gets_texts_in_small_batches(spark, monkeypatch):
    """Batches of 10,000 rows, whatever they weigh, lay twice in each worker and in the JVM."""
    seen = []
    monkeypatch.setattr(packing, "stored", lambda df, name, f=packing.stored: seen.append(spark.conf.get(BATCH_BYTES, None)) or f(df, name))
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 800).alias("text"))
    assert pack_documents(docs, WORD).count() == 3000
    assert len(seen) == 1 and int(seen[0]) <= 4 << 20 and spark.conf.get(BATCH_BYTES, None) is None
    weigh = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    with small_batches(spark, 1 << 20):
        sizes = [r.n for r in docs.mapInArrow(weigh, "n long").collect()]
    assert len(sizes) >= 12 and max(sizes) < 1.1 * (1 << 20)


def test_small_batches_leave_a_size_that_the_session_has(spark):
    spark.conf.set(BATCH_BYTES, "123456")
    try:
        with small_batches(spark):
            assert spark.conf.get(BATCH_BYTES) == "123456"
        assert spark.conf.get(BATCH_BYTES) == "123456"
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_letters_and_signs_are_cut_together(monkeypatch):
    """The pattern was run on every distinct string between spaces; now only on those that are not letters and then signs."""
    asked = []
    monkeypatch.setattr(bpe_automaton, "cut_words", lambda part, f=bpe_automaton.cut_words: asked.append(part) or f(part))
    _, encode = bpe_automaton.encoder.__wrapped__(BYTE)
    rows = ["".join(f"Wort{'abcdefghij'[i % 10]}ü{sign} des\nJahrs{sign} " for sign in ("", ".", ",", "!?"))[:-1] for i in range(50)] + ["it's 12 don't"]
    ids, bounds = encode(pa.array(rows))
    library = Tokenizer.from_file(BYTE)
    assert [ids[a:b].tolist() for a, b in pairwise(bounds)] == [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert sorted(asked) == [" 12", " don't", "it's"]


def test_cutting_equals_the_library():
    """Every letter that Arrow may cut at, white space side by side, line ends, marks; slices without a plain text, and without text."""
    library, rng = Tokenizer.from_file(BYTE), random.Random(5)
    _, encode = bpe_automaton.encoder(BYTE)
    pieces = ["a", "T", " ", " ", " ", "iN", "1", "é", "\n", "\n", "<|endoftext|>", "'s", "'", ".", "日", "\u3000", "ß", "\0", "\t", "\r", "\x1c", "\x85", "\xa0", "!?", "ª", "²", "\u0301"]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(8000)]
    rows += ["a" + chr(c) + "b " + chr(c) + "c\n" + chr(c) + "'" for c in range(0x400)]
    for own in (rows, [" a", "b  c", "\0"], ["", "", "\n", "\n\n", "\na", "a\n\n"], ["<|endoftext|>"], [""]):
        ids, bounds = encode(pa.array(own))
        for text, a, b in zip(own, bounds, bounds[1:]):
            assert ids[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, text
