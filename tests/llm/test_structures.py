"""Near-duplicates, components, chat formatting, the codec, WARC fixity and the pipeline."""

from __future__ import annotations

import glob
import gzip
import os
import random
import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from hearth.llm import chat, components, near_dup, piece_codec, warc_fixity
from hearth.llm.queries import PIECES, damaged_copy, op3_sentencepiece, op5_chat_format, op7_minhash_dedup, op10_warc_fixity

from ..compare import assert_same, connect


def brute_components(docs, size, percent):
    """The least id of each document's component, comparing all pairs."""
    sets = {i: near_dup.shingles_of((t or "").encode(), size) for i, t in docs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_op7_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    expected = brute_components(docs, 2, 80)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op7_minhash_dedup(spark, sf_dir).collect()}
    assert found == expected and len(found) == len(docs)


def test_groups_of_near_copies(spark):
    """A large group around one text, of which many pairs aren't linked directly."""
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randrange(9)):
            words[r.randrange(len(words))] = f"x{r.randrange(10_000)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(i, " ".join(f"w{r.randrange(500)}" for _ in range(100))) for i in range(2000, 2040)] + [(5, None), (6, ""), (7, "solo"), (8, "SOLO"), (9, "a b"), (10, "A  b")]
    expected = brute_components(rows, 2, 80)
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, component_id int")
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.find(docs, size=2).collect()} == expected


def test_near_dup_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "a b c d e f"), (None, None), (4, "q r"), (4, "z z z")]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, kept string")
    found = near_dup.find(docs, size=2).collect()
    assert len(found) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in found} == {(1, 1, True), (2, 1, False), (None, None, True), (4, 4, True)}
    stay = near_dup.keep_one(docs, size=2)
    assert stay.columns == docs.columns and sorted(str((r["doc_id"], r["text"])) for r in stay.collect()) == sorted(str(x) for x in [(1, "a b c d e f"), (None, "a b c d e f"), (None, None), (4, "z z z")])
    assert near_dup.find(docs.where("false")).collect() == [] and near_dup.keep_one(docs.where("false")).collect() == []


def test_ids_of_any_kind(spark):
    rows = [("b", "a b c d"), ("a10", "A b c d"), ("a9", "x y z"), (None, "a b c d"), ("c", None), ("b", "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_dup.find(docs, size=2).collect())
    assert found == sorted([("b", 3, "a10", False)] * 2 + [("a10", 3, "a10", True), ("a9", 2, "a9", True), ("None", 3, "None", True), ("c", 0, "c", True)])
    assert sorted(str(r["doc_id"]) for r in near_dup.keep_one(docs, size=2).collect()) == ["None", "a10", "a9", "c"]
    assert near_dup.find(docs.where("false")).collect() == []
    small = spark.createDataFrame([(1, "p q"), (2, "p q")], "doc_id short, text string")
    assert dict(near_dup.find(small, size=2).dtypes)["component_id"] == "smallint" and near_dup.keep_one(small, size=2).count() == 1


def test_near_copies_of_very_long_texts(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    other = list(base)
    for k in range(0, 60_000, 50):
        other[k] = "changed"
    docs = spark.createDataFrame([(3, " ".join(base)), (2, " ".join(other)), (1, " ".join(reversed(base)))], "doc_id long, text string")
    assert {(x["doc_id"], x["component_id"]) for x in near_dup.find(docs, size=5).collect()} == {(3, 2), (2, 2), (1, 1)}


def test_components_equal_union_find(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: find(i) for e in edges if e[0] != e[1] for i in e}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


TEXTS = ["plain", "", "</s>[INST] ok [/INST]", "[\\INST] [INST] [\\\\INST]", "a\\", "<<SYS>> x <</SYS>>", "[ROLE=41] [/ROLE]", " <s> \n </s>\n", "[INST", "<\\/s>", "x" * 50_000 + "</s>"]


def test_chat_round_trip(spark):
    rows = [(i, k, role, text) for i, text in enumerate(TEXTS) for k, role in enumerate(("system", "user", "assistant", "tool <x>", ""))] + [(99, None, None, None), (99, None, None, None), (None, 1, "user", "x")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    found = {r["conv_id"]: r for r in chat.format_chats(turns).withColumn("back", chat.parse(F.col("formatted"))).collect()}
    for i, text in enumerate(TEXTS):
        r = found[i]
        assert r["round_trip"] and [(t["role"], t["text"]) for t in r["back"]] == [(x, text) for x in ("system", "user", "assistant", "tool <x>", "")]
        (span,) = r["loss_spans"]
        inside = r["formatted"][span["begin"] : span["end"]]
        assert ("\\" in inside or inside == text) and not any(m in inside for m in ("[INST]", "</s>", "<s>", "<<SYS>>"))
    assert found[0]["n_escaped"] == 0 and found[2]["n_escaped"] == 5 and len(found[99]["back"]) == 2 and found[None]["round_trip"]
    assert chat.format_chats(turns.where("false")).collect() == []


def test_chat_is_native(spark, sf_dir):
    plan = op5_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("query", [op5_chat_format, op10_warc_fixity])
def test_equals_sql(spark, sf_dir, query):
    from hearth.llm.oracles import SQL

    assert_same(query(spark, sf_dir), SQL[query.__name__], connect(sf_dir))


def test_codec_parity_on_whole_texts(spark, sf_dir):
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["parity"] and r["round_trip"] and r["ids"] == reference.encode(texts[r["doc_id"]])


def test_codec_edge_cases(spark):
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [None, "", " ", "  a\n\nb  ", "▁x", "💩 \t é\x00", "a" * 20_000, "x", "x"]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, IDS int, Parity int")
    rows = sorted(piece_codec.decode(piece_codec.encode(docs, PIECES), PIECES).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(rows, texts, strict=True):
        if t is None:
            assert r["ids"] is None and r["parity"] is None and r["decoded"] is None
        else:
            assert r["ids"] == reference.encode(t) and r["parity"] and r["decoded"] == t.replace("▁", " ") and r["round_trip"] == ("▁" not in t)
    assert piece_codec.encode(docs.where("false"), PIECES).collect() == []


def test_unigram_model_is_rebuilt(tmp_path):
    """A small unigram model file, made field by field: its tokenizer agrees with the other library."""
    from hearth.llm.vocabulary import parse_model

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3 & 0x7F | (0x80 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
        return bytes([number << 3 | 2]) + bytes([len(value)]) + value

    import struct

    def piece(text, score, kind):
        body = field(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + field(3, kind)
        return field(1, body)

    pieces = [("<unk>", 0.0, 2), ("▁", -2.0, 1), ("▁a", -1.5, 1), ("b", -2.5, 1), ("ab", -1.0, 1), ("a", -3.0, 1), ("▁ab", -2.2, 1), ("c", -4.0, 1)]
    data = b"".join(piece(*p) for p in pieces) + field(2, field(3, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    model = parse_model(data)
    assert model.model_type == 1 and [p for p, *_ in pieces] == model.pieces
    ours, other = piece_codec.build_tokenizer(model), sentencepiece.SentencePieceProcessor(model_proto=data)
    for text in ("ab", "a b abc", "cab ab", "bbb"):
        assert ours.encode(text, add_special_tokens=False).ids == other.encode(text)
    # whole texts are units of such a model; the table holds one batch of them
    codec = piece_codec.Codec(data)
    for texts in (["ab", None, "", "a b abc"], ["cab ab " * 1000, "ab"]):
        ids, sizes, parity, same = codec.encode(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [other.encode(x) if x else [] for x in texts]
        assert parity == same == [None if x is None else True for x in texts] and len(codec.known.at) <= len(texts)


def test_codec_tables_are_renewed(monkeypatch):
    """Small tables: units are forgotten and encoded again, results stay."""
    monkeypatch.setattr(piece_codec, "CACHE_UNITS", 40)
    monkeypatch.setattr(piece_codec, "BATCH_UNITS", 7)
    monkeypatch.setattr(piece_codec, "JOINED_UNITS", 3)
    with open(PIECES, "rb") as f:
        codec = piece_codec.Codec(f.read())
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    r = random.Random(1)
    for k in range(30):
        texts = [" ".join(r.choice(["the", "of", f"w{r.randrange(300)}", "💩é", "x\n\ny", "▁", "  z"]) for _ in range(r.randrange(8))) for _ in range(4)]
        ids, sizes, parity, same = codec.encode(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [reference.encode(x) for x in texts]
        assert all(parity) and same == ["▁" not in x for x in texts]


def pages(spark, n, extra=()):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>é{i}</p>\r\n\r\nx" * (i % 5)) for i in range(n)] + list(extra), "page_id long, url string, html string")


def test_audit_finds_the_damage(spark):
    table = pages(spark, 400, [(None, None, None), (5, "http://h/5", "<p>é5</p>\r\n\r\nx" * 0), (5, "http://h/5", "")]).withColumn("node", F.lit(1))
    a, b = warc_fixity.build(table, 4), warc_fixity.build(damaged_copy(table), 4)
    kinds = {(r["page_id"], r["kind"]) for r in warc_fixity.damage(a, b).collect()}
    altered = {(str(i), "altered") for i in range(400) if i % 101 == 7}
    assert kinds == altered | {(str(i), "missing") for i in range(400) if i % 101 == 11} | {(str(i), "extra") for i in range(400) if i % 101 == 13}
    same = warc_fixity.build(table, 4)
    assert same.root == a.root and warc_fixity.damage(a, same).collect() == [] and all(r["intact"] for r in warc_fixity.audit(a, same).collect())
    none = warc_fixity.build(table.where("false"), 1)
    assert none.root == "" and warc_fixity.audit(none, none).collect() == []
    assert {r["kind"] for r in warc_fixity.damage(none, a).collect()} == {"extra"}


def test_damaged_files_are_read(spark, tmp_path):
    """Bytes are lost, changed and cut off: each file is read to its end and the audit names what is hurt."""
    table = pages(spark, 60)
    warc_fixity.write(table, f"{tmp_path}/warc", 3, compression="none")
    names = sorted(glob.glob(f"{tmp_path}/warc/archive=*/part-*.txt"))
    data = {n: open(n, "rb").read() for n in names}
    assert len(names) == 3 and all(list(warc_fixity.records_of(d))[-1][2] == len(d) and not any(r[5] for r in warc_fixity.records_of(d)) for d in data.values())
    keys = {n: [r[3] for r in warc_fixity.records_of(d)] for n, d in data.items()}
    for crc in glob.glob(f"{tmp_path}/warc/archive=*/.*.crc"):  # the file system's own check would stop at once
        os.remove(crc)
    a, b, c = names
    at = [r[0] for r in warc_fixity.records_of(data[a])]
    open(a, "wb").write(data[a][:-20])  # cut off inside the last record
    begin, middle = [r[:2] for r in warc_fixity.records_of(data[b])][2]
    open(b, "wb").write(data[b][: begin + 3] + b"?" + data[b][begin + 4 :])  # one byte of a header's first line
    third = list(warc_fixity.records_of(data[c]))[3]
    open(c, "wb").write(data[c][: third[1]] + b"more" + data[c][third[1] :])  # a body longer than it says
    back = warc_fixity.read(spark, f"{tmp_path}/warc").collect()
    assert sorted((r["fault"], r["page_id"]) for r in back if r["fault"]) == sorted([("truncated", keys[a][-1]), ("header", ""), ("length", keys[c][3])])
    found = {(r["page_id"], r["kind"]) for r in warc_fixity.damage(warc_fixity.build(table, 3), warc_fixity.build_from_files(spark, f"{tmp_path}/warc")).collect()}
    assert found == {(keys[a][-1], "altered"), (keys[b][2], "missing"), ("", "extra"), (keys[c][3], "altered")}
    assert len(at) == len(keys[a]) and list(warc_fixity.records_of(b"")) == [] and [r[5] for r in warc_fixity.records_of(b"noise")] == ["header"]
    packed = gzip.compress(data[a][:3000]) + gzip.compress(data[a][3000:])
    assert warc_fixity.plain_bytes(packed) == data[a] and data[a].startswith(warc_fixity.plain_bytes(packed[:-300])) and warc_fixity.plain_bytes(packed[:40] + b"?" + packed[41:]) != data[a]
    whole = warc_fixity.build_from_files(spark, f"{tmp_path}/warc")
    assert whole.root != warc_fixity.build(table, 3).root
    warc_fixity.write(table.where("false"), f"{tmp_path}/none", 1)
    assert warc_fixity.build_from_files(spark, f"{tmp_path}/none").root == ""


def test_a_damaged_member_costs_one_record(spark, tmp_path):
    """Any byte of one member of 60 is changed, or the file is cut: the others are read, the damage has a fault."""
    table = pages(spark, 60)
    warc_fixity.write(table, f"{tmp_path}/warc", 1)
    (name,) = glob.glob(f"{tmp_path}/warc/archive=0/part-*.txt")
    data = open(name, "rb").read()
    plain = gzip.decompress(data)
    assert plain.count(b"WARC/1.1") == data.count(warc_fixity.MEMBER_BEGIN) == 60
    whole = list(warc_fixity.records_in(warc_fixity.inflated(data)))
    assert len(whole) == 60 and not any(r[5] for r in whole) and b"".join(r[6] for r in whole) == plain and whole[-1][2] == len(plain)
    starts = [m.start() for m in re.finditer(re.escape(warc_fixity.MEMBER_BEGIN), data)]
    for k in (0, 17, 59):
        stop = starts[k + 1] if k < 59 else len(data)
        for at in range(starts[k], stop, 7 if k else 1):
            hurt = list(warc_fixity.records_in(warc_fixity.inflated(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])))
            good = {r[3] for r in hurt if not r[5]}
            if at - starts[k] >= 10 or at - starts[k] < 2:  # the header's flags, time and system change no record
                assert len([r for r in hurt if r[5]]) == 1, (k, at)
            assert {r[3] for i, r in enumerate(whole) if i != k} <= good, (k, at)
    cut = list(warc_fixity.records_in(warc_fixity.inflated(data[:-30])))
    assert len([r for r in cut if not r[5]]) == 59 and [r[5] for r in cut if r[5]] == ["compressed"]
    for crc in glob.glob(f"{tmp_path}/warc/archive=0/.*.crc"):
        os.remove(crc)
    at = starts[17] + 60
    open(name, "wb").write(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])
    back = warc_fixity.read(spark, f"{tmp_path}/warc").collect()
    assert len(back) == 60 and [r["fault"] for r in back if r["fault"]] == ["compressed"]


def test_foreign_files_are_read(spark, tmp_path):
    """Version 1.0, header names of any case, names of the format, a member for all records or for each."""
    record = "WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID:<urn:uuid:{0}>\r\nwarc-target-uri: http://x/{0}\r\ncontent-length:  {1}\r\n\r\n{2}\r\n\r\n"
    rows = [record.format(i, len(body), body).encode() for i, body in enumerate(["a", "", "WARC", "x" * 300_000])]
    os.makedirs(f"{tmp_path}/in/archive=3")
    for name, data in (("a.warc", b"".join(rows)), ("b.warc.gz", gzip.compress(b"".join(rows))), ("c.warc.gz", b"".join(map(gzip.compress, rows))), ("d.warc.gz", gzip.compress(b"".join(rows)[:50]) + gzip.compress(b"".join(rows)[50:]))):
        open(f"{tmp_path}/in/archive=3/{name}", "wb").write(data)
    back = warc_fixity.read(spark, f"{tmp_path}/in").collect()
    assert len(back) == 16 and not any(r["fault"] for r in back) and {r["archive"] for r in back} == {3}
    assert sorted((r["page_id"], r["url"], len(r["html"])) for r in back) == sorted([("<urn:uuid:0>", "http://x/0", 1), ("<urn:uuid:1>", "http://x/1", 0), ("<urn:uuid:2>", "http://x/2", 4), ("<urn:uuid:3>", "http://x/3", 300_000)] * 4)


def test_a_missing_record_opens_one_branch(spark):
    table = pages(spark, 3000)
    a, b = warc_fixity.build(table, 2), warc_fixity.build(table.where("page_id <> 11"), 2)
    opened = [(x.count(), y.count()) for x, y in warc_fixity.descend(a, b)]
    # two roots, then eight nodes a level of one branch, then a slot's records (six on average)
    assert opened[0] == (2, 2) and all(x <= 8 and y <= 8 for x, y in opened[1:-1]) and opened[-1][0] <= 20 and opened[-1][1] == opened[-1][0] - 1
    assert [(r["page_id"], r["kind"]) for r in warc_fixity.damage(a, b).collect()] == [("11", "missing")]


def test_very_long_pages(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "é" * 2_000_000), (1, "u", "é" * 2_000_000), (2, "v", "WARC/1.1\r\n\r\n" * 1000)], "page_id long, url string, html string")
    warc_fixity.write(table, f"{tmp_path}/long", 1)
    assert warc_fixity.build_from_files(spark, f"{tmp_path}/long").root == warc_fixity.build(table, 1).root


def test_files_round_trip(spark, tmp_path):
    table = pages(spark, 60)
    warc_fixity.write(table, f"{tmp_path}/warc", 3)
    back = warc_fixity.read(spark, f"{tmp_path}/warc")
    assert sorted((r["page_id"], r["url"], r["html"]) for r in back.collect()) == sorted((str(r["page_id"]), r["url"], r["html"]) for r in table.collect())
    tree = warc_fixity.build(table, 3)
    ranges = {(r["page_id"], r["begin"], r["end"]) for r in tree.levels[0].collect()}
    assert {(r["page_id"], r["begin"], r["end"]) for r in back.collect()} == ranges
    assert warc_fixity.build(back.select("page_id", "url", "html"), 3).root == tree.root == warc_fixity.build_from_files(spark, f"{tmp_path}/warc").root


def test_pipeline_equals_brute_force(spark, sf_dir):
    import corpus_pipeline

    from .test_filters import brute_counts

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]
    # too few labels at this size to certify a cutoff: the base rules alone decide
    kept = {}
    for i, r in docs.items():
        n, _, _, _, repeats = brute_counts(r["text"])
        if n >= 50 and 100 * repeats <= 50 * n:
            kept[i] = r["text"]
    groups = brute_components(list(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    windows = {tuple(w[k : k + 10]) for w in (plain_words(t) for t in items) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    kept = {i: t for i, t in kept.items() if not any(tuple(w[k : k + n]) in windows for w in [plain_words(t)] for n in sizes for k in range(len(w) - n + 1))}
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} == set(kept)
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in out:
        assert r["ids"] == reference.encode(r["text"]) and r["n_chars"] == len(r["text"]) and (r["text"] == kept[r["doc_id"]] or "[SECRET]" in r["text"])


def test_pipeline_edge_cases(spark, tmp_path):
    """Nulls, repeated rows, empty and very long texts, clashing columns, ties, an empty table: each stage and the whole."""
    import corpus_pipeline

    r = random.Random(4)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(100_000))
    plain = " ".join(f"p{r.randrange(10**6)}" for _ in range(80))
    hidden = " ".join(f"q{r.randrange(10**6)}" for _ in range(80)) + " token=abcdef123456"
    rows = [(1, plain, "en"), (1, plain, "en"), (2, plain.upper(), "en"), (3, None, None), (4, "", "fr"), (None, long, None), (5, long + " x", "de"), (6, hidden, None), (7, plain + " one two three four five six seven eight nine ten", "en")]
    extra = "source string, n_chars long, ids int, kept boolean, __counts int, component_id string"
    docs = spark.createDataFrame([(*x, None, 5, 1, True, 2, "c") for x in rows], f"doc_id long, text string, lang string, {extra}")
    bench = [(1, "one two three four five six seven eight nine ten"), (2, None), (None, "x")]
    for name, frame, empty in (("full", docs, False), ("empty", docs.where("false"), True)):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        items, labels = spark.createDataFrame(bench, "item_id long, text string"), spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
        (items.where("false") if empty else items).write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        (labels.where("false") if empty else labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, frame, f"{tmp_path}/{name}").columns == docs.columns, stage
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    kept = sorted((str(x["doc_id"]), len(x["text"])) for x in out)
    # 7 is a near copy of 1 and goes before its benchmark passage is seen; the long text without an id is linked with nothing
    assert kept == sorted([("1", len(plain)), ("None", len(long)), ("5", len(long) + 2), ("6", len(hidden) - len("token=abcdef123456") + len("[SECRET]"))])
    assert all(x["parity"] and x["round_trip"] and len(x["ids"]) == x["n_ids"] for x in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []


def plain_words(text):
    import re

    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
