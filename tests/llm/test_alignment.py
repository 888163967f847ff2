"""Alignment of two vocabularies against a version that codes every text whole and keeps all links in memory."""

import hashlib
from collections import Counter

import pytest

from lakeops.llm import QUERIES, alignment
from lakeops.llm.bpe import byte_characters
from lakeops.llm.vocabularies import BYTE_BPE, PIECE_BPE, path


@pytest.fixture(scope="module")
def coders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path(BYTE_BPE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path(PIECE_BPE))


def plain_groups(text, coders):
    a, b = coders
    if not text:
        return []
    byte_of = {c: i for i, c in enumerate(byte_characters())}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return []

    def by_end(ids, parts):
        at, out = 0, []
        for i, p in zip(ids, parts):
            at += len(p)
            out.append((at, i))
        return out

    ends_a, ends_b = by_end(ids_a, bytes_a), by_end(ids_b, bytes_b)
    cuts = sorted({e for e, _ in ends_a} & {e for e, _ in ends_b})
    return [([i for e, i in ends_a if low < e <= high], [i for e, i in ends_b if low < e <= high]) for low, high in zip([0, *cuts], cuts)]


def plain_alignment(rows, coders):
    groups = [(k, plain_groups(t, coders)) for k, t in rows]
    count = Counter()
    for _, g in groups:
        count.update({(a, b) for xs, ys in g for a in xs for b in ys})
    best = Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for k, g in groups:
        links = [(a, b) for xs, ys in g for a in xs for b in ys]
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        out.append((k, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_is_the_plain_version_over_all_documents(spark, sf, coders):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(QUERIES["op11_cross_tokenizer_alignment"](spark, sf)) == plain_alignment(rows, coders)


def test_odd_texts_keys_and_columns(spark, odd, coders):
    more = spark.createDataFrame(
        [(100 + i, t, "x", "y") for i, t in enumerate(["a\r\nb\rc", "\r", "▁a b", "x\ty  z", "<s> </s> <unk> <0x41>", "ﬁ Ａ", "\n\n  a", " "])], odd.schema)
    docs = odd.unionByName(more).repartition(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(alignment.align(docs, path(BYTE_BPE), path(PIECE_BPE))) == plain_alignment(rows, coders)


def test_no_rows(spark, no_rows):
    assert got(alignment.align(no_rows, path(BYTE_BPE), path(PIECE_BPE))) == []


def test_only_irregular_pairs_are_shuffled(spark):
    own = alignment.aligner(path(BYTE_BPE), path(PIECE_BPE))
    import pyarrow as pa

    codes, bounds, groups = alignment.aligned(pa.array(["the cat", "the"]), own)
    same = groups.pairs.tolist()
    assert same and all(own.identity[p >> 32] == p & 0xFFFFFFFF for p in same)
    assert own.bytes_a[same[0] >> 32] == own.bytes_b[same[0] & 0xFFFFFFFF]


def test_rows_of_megabytes_do_not_pile_up_in_a_row_group(spark):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from lakeops.llm.shared import written

    rows = spark.range(0, 40, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: F.xxhash64("id", x)).alias("x"))
    table = written(rows, "large", block_bytes=1 << 20)
    groups = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata.num_row_groups for f in table.inputFiles()]
    assert table.count() == 40 and sum(groups) >= 4
