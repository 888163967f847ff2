"""Token files, BPE and packing against the tokenizers library."""

import collections
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeops.llm import bpe, chunks, packing, token_files
from lakeops.llm.elias_fano import EliasFano
from lakeops.llm.queries import digest_pieces
from lakeops.llm.vocabularies import BYTE_BPE, WORD_BPE, path
from tests.llm.conftest import ODD

TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\x0b\x1c\x85 ab'.,*<|>s1é漢"), st.characters(exclude_categories=["Cs"])), max_size=60)


def plain(name):
    t = Tokenizer.from_file(path(name))
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_chunked_ids_are_the_librarys(texts):
    for name, white in ((BYTE_BPE, True), (WORD_BPE, False)):
        ids, counts = chunks.encode_texts(pa.array(texts, pa.string()), path(name), white)
        want = [plain_coders[name](t) for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


plain_coders = {n: plain(n) for n in (BYTE_BPE, WORD_BPE)}


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_own_bpe_is_the_librarys(text):
    own = bpe.byte_pairs(path(BYTE_BPE))
    ids = plain_coders[BYTE_BPE](text)
    assert own.encode(text) == ids
    assert own.decode(ids) == text


def test_chunks_join_to_the_text():
    words = chunks.split_chunks(pa.array(ODD))
    for i, t in enumerate(ODD):
        assert "".join(words.distinct[int(c)].as_py() for c in words.codes[words.bounds[i]:words.bounds[i + 1]]) == (t or "")


def test_a_full_table_of_chunks_changes_nothing():
    small = chunks.Coder(path(BYTE_BPE), remembered=2)
    large = chunks.Coder(path(BYTE_BPE))
    texts = [t for t in ODD if t] * 2
    assert small.ids(texts) == large.ids(texts)
    assert len(small.known) <= 2


@given(st.lists(st.integers(-2**63, 2**63 - 1), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    ef, end = EliasFano.load(b"xx" + EliasFano.of(np.array(values, np.int64)).dump() + b"yy", 2)
    assert ef.all().tolist() == values
    for i in range(0, len(values), 7):
        assert ef.select(i) == values[i]


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(0, 2000, 100_000))
    assert len(EliasFano.of(values).dump()) < 100_000 * (2 + np.log2(1000) + 1.5) / 8


@pytest.mark.parametrize("segment_ids", [1, 1 << 20])
def test_token_files_return_every_document(spark, odd, fresh, segment_ids):
    where = fresh("tokens")
    token_files.write_tokens(odd, where, path(BYTE_BPE), segment_ids=segment_ids)
    got = token_files.read_tokens(spark, where).orderBy("position").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    at = 0
    assert [r.position for r in got] == list(range(len(rows)))
    for r, (key, text) in zip(got, rows):
        ids = plain_coders[BYTE_BPE](text) + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, at, len(ids), crc(ids))
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)


def test_one_document_by_select(spark, odd, fresh):
    where = fresh("tokens")
    token_files.write_tokens(odd, where, path(BYTE_BPE))
    for f in spark.read.format("binaryFile").load(f"{where}/segments").collect():
        s = token_files.load_segment(bytes(f.content))
        edges = s.bounds.all()
        for i in range(len(s.keys)):
            assert s.document(i).tolist() == s.ids[edges[i]:edges[i + 1]].tolist()


def test_token_files_of_an_empty_table(spark, no_rows, fresh):
    where = fresh("tokens")
    token_files.write_tokens(no_rows, where, path(BYTE_BPE))
    assert token_files.read_tokens(spark, where).collect() == []


def test_bpe_digests(odd, no_rows):
    got = bpe.encode_decode_digest(odd, path(BYTE_BPE)).collect()
    want = []
    for r in odd.collect():
        ids = plain_coders[BYTE_BPE](r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert bpe.encode_decode_digest(no_rows, path(BYTE_BPE)).collect() == []


def test_bpe_columns_round_trip(odd):
    done = bpe.decode_column(bpe.encode_column(odd, path(BYTE_BPE), out="codes"), path(BYTE_BPE), ids="codes")
    assert done.columns == ["doc_id", "text", "part", "ids", "codes", "decoded"]
    assert all(r.decoded == (r.text or "") for r in done.collect())


@pytest.mark.parametrize("size", [7, 64, 4096])
def test_packing_lays_out_every_id_once(spark, odd, size):
    pieces = packing.pack(odd, path(WORD_BPE), size=size)
    rows = pieces.collect()
    texts = collections.Counter((r.doc_id, r.text or "") for r in odd.collect())
    streams = collections.defaultdict(list)
    for r in rows:
        streams[r.sequence_id].append(r)
    stream = []
    for k in range(len(streams)):
        at = 0
        for r in sorted(streams[k], key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
            stream.append(r)
        assert at == size or k == len(streams) - 1
    documents = []
    for r in stream:
        if r.start == 0:
            documents.append((r.doc_id, []))
        assert documents[-1][0] == r.doc_id and len(documents[-1][1]) == r.start
        documents[-1][1].extend(np.frombuffer(r.ids, "<u4").tolist())
    want = collections.Counter((k, tuple(plain_coders[WORD_BPE](t)) + (2,)) for (k, t), n in texts.items() for _ in range(n))
    assert collections.Counter((k, tuple(ids)) for k, ids in documents) == want
    digests = digest_pieces(pieces).collect()
    assert sorted(r.ids_crc32 for r in digests) == sorted(zlib.crc32(bytes(r.ids)) for r in rows)
    for s in packing.sequences(pieces, size, pad_id=9).collect():
        ids = np.frombuffer(s.ids, "<u4").tolist()
        parts = sorted(streams[s.sequence_id], key=lambda r: r.offset)
        real = [i for r in parts for i in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == real + [9] * s.padding and [b.offset for b in s.boundaries] == [r.offset for r in parts]
        assert len(ids) == size or len(real) & (len(real) - 1) == 0


def test_packing_an_empty_table(no_rows):
    assert packing.pack(no_rows, path(WORD_BPE)).collect() == []


def test_new_chunks_are_coded_many_at_once(monkeypatch):
    own, given = chunks.Coder(path(BYTE_BPE)), []

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            given.append(len(texts))
            return tokenizer.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    tokenizer, own.tokenizer = own.tokenizer, Counting()
    texts = [f" w{i:x}é{'.' * (i % 2)}" for i in range(chunks.AT_ONCE)]
    ids, counts = own.coded(pa.array(texts, pa.large_string()))
    want = [plain_coders[BYTE_BPE](t) for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert sum(given) <= 3  # the words, the mark, and no mark


def test_a_letter_that_becomes_two_stays_with_the_marks_after_it():
    texts = ["wordİ!", "İ.", "İ", "xİ yŸ, ẞ;"]
    ids, _ = chunks.encode_texts(pa.array(texts), path(WORD_BPE), False)
    assert ids.tolist() == [i for t in texts for i in plain_coders[WORD_BPE](t)]
