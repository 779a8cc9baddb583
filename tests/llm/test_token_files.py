import os
import zlib

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from lumaspark.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


def test_round_trip(spark):
    rows = [(i * 7 % 101, f"text number {i} with <|endoftext|> words\nand " + "long " * (i % 13) * 20) for i in range(101)]
    rows += [(200, None), (201, ""), (None, "null id"), (202, "é" * 9000)]
    rows += [(300, t) for t in ("b same id", None, "a same id", "a same id")] + [(301, "Word, word; WORD!! naïve слово, 12a x1 'tis don't 中文 ...\n-- (end)"), (302, "w" * 50_000 + " " + "," * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tokens", "2 as part").repartition(5)
    got = token_files.round_trip(docs, PATH).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows)


def test_layout(spark, tmp_path):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('some words and number ', id) as text")
    path = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, path, PATH)
    names = sorted(f for f in os.listdir(tmp_path / "t") if f.endswith(".parquet"))
    last = -1
    for name in names:
        file = pq.ParquetFile(tmp_path / "t" / name)
        ids = file.read(columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and (not ids or ids[0] > last)
        last = ids[-1] if ids else last
        for g in range(file.metadata.num_row_groups):
            group = file.metadata.row_group(g)
            columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
            assert all(c.has_offset_index and c.has_column_index for c in columns.values())
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
    few = token_files.read_token_files(spark, path).where("doc_id = 4321")
    assert few.count() == 1 and few.first().tokens[-1] == 0
    plan = token_files.read_token_files(spark, path).select("doc_id", "start")._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("Physical Plan")[1]


def test_empty_table(spark):
    assert token_files.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


class Counted:
    """The library's model, and what it was asked for."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, match):
        self.asked.append(match)
        return self.model.tokenize(match)


def counted_encoder():
    with open(PATH, encoding="utf-8") as f:
        encoder = token_files.LibraryEncoder(f.read())
    encoder.model = Counted(encoder.model)
    return encoder


def same_as_library(encoder, texts):
    ids, first = encoder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids for t in texts]


def test_words_of_earlier_chunks_are_not_encoded_again():
    encoder = counted_encoder()
    same_as_library(encoder, ["uncommonly rare wordings, naïve слово!!", "rare; wordings"])
    asked = len(encoder.model.asked)
    assert asked > 0
    same_as_library(encoder, ["wordings, uncommonly rare; wordings!!", None, "", "uncommonly naïve, слово!!"])
    assert len(encoder.model.asked) > asked  # "wordings" begins a text for the first time
    asked = len(encoder.model.asked)
    same_as_library(encoder, ["uncommonly naïve, слово!! rare", "wordings uncommonly"])
    assert len(encoder.model.asked) == asked


def test_full_memo(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO", 24)
    encoder = counted_encoder()
    for n in range(8):
        same_as_library(encoder, [f"often seen {'abcdefgh'[n]}{'ijklmnop'[n]}word,, {'x' * (n + 60)} mehr {'qrstuvyz'[n] * 3}!", "often seen; 12 a\n\nb <|endoftext|> c", "often seen\nseen often"])
        assert len(encoder.met) <= 24 and len(encoder.met_ids) == encoder.met_sizes.sum()
        assert all(len(w.encode()) <= token_files.MEMO_BYTES for w in encoder.met.to_pylist())
    assert len(encoder.model.asked) > 24 and encoder.model.asked.count("Ġseen") == 1  # the most used stay
