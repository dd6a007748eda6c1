"""Sharding, packing, token files and top-k on awkward tables."""
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cataloom.llm import huffman
from cataloom.llm.huffman import canonical, code_lengths, decode_table, read_file, round_trip, write_file
from cataloom.llm.packing import improve, pack, pack_documents, pack_lengths
from cataloom.llm.queries import tokenizer
from cataloom.llm.sharding import shard_rows
from cataloom.llm.tokens import Encoder
from cataloom.llm.topk import top_k

TEXTS = ["Hello, World!  two  spaces", " lead", "trail ", "a\n b", "it's don't WE'LL", "naïve Ünï 東京 ẞ İ", "tab\tx  \n y", "", "x" * 500, "1234 5,6", "ﬁ é   z", "<|endoftext|> a <|x", "a \u0085 b", "ça ÇA ×÷ µ"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    import pyarrow as pa

    path = tokenizer(name)
    ids, offsets = Encoder(path).encode(pa.array([*TEXTS, None, *TEXTS]))
    whole = Tokenizer.from_file(path)
    for i, text in enumerate([*TEXTS, "", *TEXTS]):
        assert ids[offsets[i]:offsets[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_are_remembered_apart_from_their_marks(name):
    """Every word with every mark behind it: ids of the whole tokenizer, and an entry a word, a mark and a first piece."""
    import pyarrow as pa

    path = tokenizer(name)
    words, marks = [f"{a}{b}{c}" for a in "xyÀé" for b in "aou" for c in ("", "ß", "N")], ["", ",", ".", "!!", "-)", "%&"]
    text = " ".join(w + m for w in words for m in marks)
    encoder = Encoder(path)
    for _ in range(2):
        ids, offsets = encoder.encode(pa.array([text, None, "0 1", "", text]))
        want = [encoder.whole.encode(t, add_special_tokens=False).ids for t in (text, "", "0 1", "", text)]
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert len(encoder.start) <= len(words) + len(marks) + 8



def test_shards(awkward, empty):
    rows = shard_rows(awkward, 4).collect()
    assert len(rows) == awkward.count()
    total, before = sum(r["size"] for r in rows), {}
    for r in rows:
        before.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in before.values())
    order = sorted({(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows})
    at = 0
    for key in order:
        same = [r for r in rows if (r["doc_id"] is not None, r["doc_id"] or 0) == key]
        if len(same) == 1:
            assert same[0]["shard"] == 4 * at // total
        at += sum(r["size"] for r in same)
    assert shard_rows(empty).count() == 0 and {"shard", "slot", "size"} < set(shard_rows(empty).columns)


def test_shards_in_parts(spark):
    docs = spark.range(1000).selectExpr("id * 37 % 1000 as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    rows = sorted(shard_rows(docs, 3, part_rows=100).collect(), key=lambda r: r["doc_id"])
    total, at, slots = sum(r["size"] for r in rows), 0, [0, 0, 0]
    for r in rows:
        assert (r["shard"], r["slot"]) == (3 * at // total, slots[3 * at // total])
        slots[r["shard"]] += 1
        at += r["size"]


def test_pack_lengths():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 4097, 3000), np.full(50, 4096), np.full(99, 1366), np.array([1]), np.array([], int), rng.integers(1400, 2100, 2000)):
        where, offset = pack_lengths(lengths)
        for b in np.unique(where):
            mine = np.flatnonzero(where == b)
            mine = mine[np.argsort(offset[mine])]
            assert offset[mine].tolist() == (np.cumsum(lengths[mine]) - lengths[mine]).tolist() and lengths[mine].sum() <= 4096


def steps_left(bins, capacity):
    """Moves and exchanges, by trying all, that would raise the sum of squared fills."""
    for s, source in enumerate(bins):
        for t, target in enumerate(bins):
            room = capacity - sum(target)
            if s == t or not room:
                continue
            backs = {*target, *(x + y for i, x in enumerate(target) for y in target[i + 1:])}
            for x in set(source):
                if x <= room and sum(target) + x > sum(source):
                    yield s, t, x, 0
                if sum(target) >= sum(source) and x > room:
                    yield from ((s, t, x, y) for y in backs if x - room <= y < x)


@pytest.mark.parametrize("low, high", [(1000, 1700), (100, 700), (1, 4096)])
def test_search_ends_without_a_step_left(low, high):
    rng = np.random.default_rng(2)
    lengths = rng.integers(low, high, 600)
    packed = improve([[x] for x in lengths.tolist()], 4096)
    assert sorted(x for b in packed for x in b) == sorted(lengths.tolist()) and max(map(sum, packed)) <= 4096
    assert next(steps_left([b for b in packed if sum(b) < 4096], 4096), None) is None


def check_packed(rows):
    seq = {}
    for r in rows:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in seq.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    return len(seq)


def test_pack_documents(awkward, empty):
    path = tokenizer("word_bpe_49k.json")
    rows = pack_documents(awkward, path).collect()
    check_packed(rows)
    whole = Tokenizer.from_file(path)
    expected = []
    for r in awkward.collect():
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        expected += [(r["doc_id"], i // 4096, i, np.array(ids[i:i + 4096], "<u4").tobytes()) for i in range(0, len(ids), 4096)]
    assert sorted(((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in rows), key=repr) == sorted(expected, key=repr)
    assert pack_documents(empty, path).count() == 0


def least_sequences(lengths, size=4096):
    """No packing takes fewer: for each short length, long pieces that leave no room for it, those that leave some, and what must go beyond their room."""
    best = 0
    for short in sorted({x for x in lengths if x <= size // 2} | {0}):
        alone = sum(x > size - short for x in lengths)
        long = [x for x in lengths if size // 2 < x <= size - short]
        rest = sum(x for x in lengths if short <= x <= size // 2) - (len(long) * size - sum(long))
        best = max(best, alone + len(long) + max(0, -(-rest // size)))
    return best


def test_pack_over_pools(spark):
    items = spark.range(2000).selectExpr("id", "1 + id * 7919 % 4096 as length", "'a' as offset")
    rows = pack(items, pool=300).collect()
    used = check_packed(rows)
    least = least_sequences([r["length"] for r in rows])
    assert len(rows) == 2000 and used <= 1.03 * least + 2


def test_huffman_codes():
    counts = np.array([0, 5, 1, 1, 0, 100000, 3, 2, 1])
    lengths = code_lengths(counts, 4)
    used = lengths > 0
    assert (used == (counts > 0)).all() and lengths.max() <= 4 and (0.5 ** lengths[used].astype(float)).sum() <= 1
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765])
    assert code_lengths(fib, 16).max() <= 16
    for ids in (np.zeros(0, int), np.array([3]), np.repeat(np.arange(20), fib)):
        lengths = code_lengths(np.bincount(ids, minlength=20))
        blob = write_file(np.array([7]), np.array([True]), np.array([len(ids)]), ids, lengths, canonical(lengths))
        assert (read_file(blob, decode_table(lengths))[3] == ids).all()


def test_codes_in_chunks(monkeypatch):
    """A file is the same whatever number of ids is placed at once."""
    rng = np.random.default_rng(7)
    ids = np.minimum(rng.geometric(0.02, 5000), 299) - 1
    lengths = code_lengths(np.bincount(ids, minlength=300))
    one = write_file(np.array([7]), np.array([True]), np.array([len(ids)]), ids, lengths, canonical(lengths))
    for chunk in (1, 7, 256, 1000):
        monkeypatch.setattr(huffman, "CHUNK", chunk)
        assert write_file(np.array([7]), np.array([True]), np.array([len(ids)]), ids, lengths, canonical(lengths)) == one
    assert (read_file(one, decode_table(lengths))[3] == ids).all()


def test_round_trip_over_files_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_BYTES", 300)
    monkeypatch.setattr(huffman, "RANGE_BYTES", 1500)
    docs = spark.range(60).selectExpr("id * 7 % 60 as doc_id", "repeat(concat('word ', id, ' '), cast(id % 9 as int)) as text")
    path = tokenizer("byte_bpe_50k.json")
    whole, start = Tokenizer.from_file(path), 0
    got = {r["doc_id"]: r for r in round_trip(docs, path).collect()}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*whole.encode(r["text"], add_special_tokens=False).ids, 2]
        mine = got[r["doc_id"]]
        assert (mine["start"], np.frombuffer(bytes(mine["ids"]), "<u4").tolist()) == (start, ids)
        start += len(ids)


def test_round_trip(awkward, empty):
    path = tokenizer("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    got = sorted(round_trip(awkward, path).collect(), key=lambda r: r["start"])
    assert [r["start"] for r in got] == (np.cumsum([r["n_tokens"] for r in got]) - [r["n_tokens"] for r in got]).tolist()
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
    assert keys == sorted(keys)
    expected = [(r["doc_id"], zlib.crc32(np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in awkward.collect()]
    assert sorted(((r["doc_id"], zlib.crc32(bytes(r["ids"]))) for r in got), key=repr) == sorted(expected, key=repr)
    assert round_trip(empty, path).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(40)], 0) for i in range(700)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(30)] + [(900, None, 0), (901, [None] * 40, 0), (902, [float("nan")] * 40, 0), (None, rows[0][1], 0), (800, [1.0, 2.0], 0), (801, [3.0, 4.0], 0), (200, rows[200][1], 0), (2000, [float("inf")] * 40, 0), (3000, [], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in top_k(vectors, candidates=100, queries=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    grid = {r[0]: [int(np.floor(1024 * float(np.float32(x)))) for x in r[1]] for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()}
    for q, v in grid.items():
        if q % 100:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in grid.items() if i != q and len(w) == len(v)))[:10]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert top_k(vectors.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Large finite vectors take part with exact scores; a component beyond a long is an error."""
    kind = "vec_id long, embedding array<double>"
    rows = [(0, [1 / 1024, 1 / 1024]), (1, [9.001e15, 1 / 1024]), (2, [9.001e15, 3 / 1024]), (3, [1.0, 1.0])]
    large = 9001 * 10 ** 12 * 1024
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, kind), k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 2, large + 3), (0, 2, 1, large + 1), (0, 3, 3, 2048)]
    with pytest.raises(Exception, match="does not fit a long"):
        top_k(spark.createDataFrame([*rows, (4, [1e16, 0.0])], kind)).collect()
