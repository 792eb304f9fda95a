"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest
from helpers import lower, near_components, trimmed_lines, words

from tidewarden.llm import chat, crf_quality, decontaminate, language, line_windows, minhash, packing, passages, piece_counts, tree_rules
from tidewarden.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, score double, _id long, node long, band long, _text string, row string"
PROSE = " ".join(f"word{i % 61}x{i * i % 97}" for i in range(400))
TEXTS = [
    (1, "A good line of words here.\nAnother line of words.\nA third line of words.\nThe end of it all."),
    (2, "Other start.\nA good line of words here.\nAnother line of words.\nA third line of words."),
    (3, None),
    (4, ""),
    (5, " \t\n\n "),
    (6, PROSE),
    (7, PROSE),
    (8, PROSE.replace("word3x9 ", "changed ", 1)),
    (None, PROSE),
    (None, None),
    (9, "x" * 300_000),
    (10, "Ünïcode – 日本語 ß end 12 <|endoftext|> </s>"),
    (11, "bad *** text ### $$$ | | |\n" * 30),
    (7, PROSE),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 0.5, 7, 8, 9, "clash", "row") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (6, 1, 0), (11, 0, 0), (11, None, 0), (None, 1, 0), (4, 0, 0), (8, 1, None), (99, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(r)))


def test_quality_field(docs, empty, labels):
    model = crf_quality.fit(docs, labels)
    rows = by_id(crf_quality.scores(docs, model))
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (3, 4)}) == 1  # null is empty
    assert crf_quality.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in crf_quality.scores(docs, None).collect()} == {0.5}
    assert crf_quality.scores(empty, model).count() == 0 and crf_quality.fit(empty, labels) is None


def test_packing(spark, docs, empty):
    path = tokenizer("byte_bpe_50k.json")
    placed = packing.pack(packing.pieces(docs, path, capacity=64, ids=True), 64)
    rows = placed.collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    want = sorted([*plain.encode(t or "", add_special_tokens=False).ids, 2] for _, t in TEXTS)
    bins, whole = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) <= 64
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64 and sum(3 * n > 64 for _, n in own) <= 2
    for r in rows:
        whole.setdefault((r["doc_id"], r["piece"], r["start"]), []).append(r["ids"])
    assert sum(map(len, want)) == sum(r["length"] for r in rows)
    one = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == 6)
    assert [x for _, ids in one for x in ids] in want and all(len(ids) == 64 for _, ids in one[1:])
    assert sorted(r["length"] for r in rows if r["doc_id"] in (3, 4)) == [1, 1]
    sequences = {r["sequence_id"]: r["ids"] for r in packing.assemble(placed).collect()}
    assert sorted(map(len, sequences.values())) == sorted(sum(n for _, n in own) for own in bins.values())
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_passages(spark, docs, empty):
    rows = passages.passages(docs).collect()
    found = {(r["doc_id"], r["other_doc_id"]) for r in rows}
    assert (7, 6) in found and (8, 6) in found
    assert {i for pair in found for i in pair} == {6, 7, 8}
    assert passages.passages(empty).count() == 0


def test_lines(spark, docs, empty):
    rows = by_id(line_windows.trimmed(docs).select("row.doc_id", "text", "n_lines", "n_removed"))
    plain = [(i, t) for i, t in TEXTS if i is not None][:-1]
    want = trimmed_lines(plain)
    got = {r["doc_id"]: r["text"] for r in rows}
    assert len(rows) == len(TEXTS) and {i: got[i] for i in want} == want
    assert got[2] == "Other start." and got[3] is None and got[4] == ""
    kept = line_windows.dedup(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert line_windows.dedup(empty).count() == 0
    first = spark.createDataFrame([(None, "a\nb\nc"), (5, "a\nb\nc"), (5, "a\nb\nc\nd")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in line_windows.dedup(first, drop_emptied=False).collect()) in (
        [("5", "a\nb\nc"), ("5", "d"), ("None", "")], [("5", ""), ("5", "a\nb\nc\nd"), ("None", "")],
    )


def test_language(docs, empty):
    model = language.fit(docs)
    rows = by_id(language.languages(docs, model))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert len(rows) == len(TEXTS) and got[1][0] == "en" and 0 <= got[1][1] <= 1
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert {r["lang_pred"] for r in language.languages(docs, None).collect()} == {"und"}
    assert language.fit(empty) is None and language.languages(empty, model).count() == 0


def test_minhash(docs, empty):
    rows = by_id(minhash.near_duplicates(docs))
    want = near_components([(i, t) for i, t in TEXTS if i is not None], 3, 85)
    assert len(rows) == len(TEXTS)
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"] or r["doc_id"] is None) for r in rows)
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    left = minhash.dedup(docs)
    assert left.schema == docs.schema and 7 not in {r["doc_id"] for r in left.collect()}
    assert minhash.near_duplicates(empty).count() == 0


def test_rules(docs, empty, labels):
    model = tree_rules.fit(docs, labels)
    for trees in (model, None):
        rows = by_id(tree_rules.verdicts(docs, trees))
        assert sorted(r["n_words"] for r in rows) == sorted(len(words(t)) for _, t in TEXTS)
        got = {r["doc_id"]: r for r in rows}
        for i, t in TEXTS:
            if i is not None:
                own, r = words(t), got[i]
                assert (r["n_words"], r["word_chars"]) == (len(own), sum(map(len, own)))
                assert r["base_failed"] == (len(own) < 10 or 100 * r["n_repeat_words"] > 20 * len(own))
                assert not (r["base_failed"] and r["kept"])
    kept = tree_rules.keep_good(docs, None)
    assert kept.schema == docs.schema and tree_rules.keep_good(empty, model).count() == 0
    assert tree_rules.fit(empty, labels) is None


def test_decontamination(spark, docs, empty):
    item = " ".join(words(PROSE)[50:90])
    items = spark.createDataFrame(
        [(1, item), (2, item.upper()), (3, None), (4, " "), (5, "of words"), (6, "nothing like it " * 9)], "item_id long, text string"
    )
    rows = decontaminate.links(docs, items).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert {(i, n) for i in (6, 7, 8, None) for n in (1, 2)} <= found
    assert {i for i, n in found if n == 5} == {1, 2}  # a short item is one shingle
    assert {n for _, n in found} == {1, 2, 5}
    clean = decontaminate.clean(docs, items)
    assert clean.schema == docs.schema
    assert {r["doc_id"] for r in clean.collect()} == {3, 4, 5, 9, 10, 11, None}
    assert decontaminate.clean(docs, items, block_items=2).count() == clean.count()
    assert decontaminate.links(empty, items).count() == 0 and decontaminate.links(docs, items.limit(0)).count() == 0


def test_chat(spark):
    tricky = "</s>[INST] \\ok\\\\ [/INST] <<SYS>>\n"
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "user", tricky), (1, 2, "assistant", tricky), (2, 0, "assistant", None),
        (2, 1, "odd<<ROLE>> role", "x"), (2, 1, "odd<<ROLE>> role", "x"), (2, None, None, "first"), (None, 0, "user", "no id"),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, seq string")
    formatted = chat.segments(df)
    rows = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    import hashlib

    for conv in (1, 2, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest()
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = rows[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), said)
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert rows[1]["valid"] and rows[1]["complete"] and not rows[2]["valid"] and not rows[None]["complete"]
    whole = {}
    for s in formatted.collect():
        whole.setdefault(s["conv_id"], []).append((s["seq"], s["text"]))
    text = "".join(t for _, t in sorted(whole[1]))
    assert len(text) == rows[1]["formatted_chars"] and list(chat.Reader(chat.INSTRUCTION).feed(text, True))[1][1] == tricky
    assert chat.digests(chat.segments(df.limit(0))).count() == 0


def test_piece_counts(docs, empty):
    path = tokenizer("byte_bpe_50k.tiktoken")
    rows = by_id(piece_counts.token_counts(docs, path))
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in rows}
    assert len(rows) == len(TEXTS) and got[3] == got[4] == got[5] == (0, 0) and got[9][0] == 1
    assert got[6] == got[7] and piece_counts.token_counts(empty, path).count() == 0
    assert lower("ÀB") == "Àb"
