"""Each method against its plain form on random or given inputs."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import greedy_pieces, near_components, trimmed_lines, words

from tidewarden.llm import arrays, chat, components, crf_quality, decontaminate, language, line_windows, minhash, packing, passages, piece_counts, spread, tree_rules
from tidewarden.llm.queries import ORACLES, QUERIES, table, tokenizer

SF = "/root/testdata/sf0.001"


def texts(sf="sf0.01"):
    return pq.read_table(f"/root/testdata/{sf}/documents.parquet")


def random_text(rng, n):
    return "".join(rng.choice(["a", "B", "é", "日", " ", "  ", "\n", "\t", "the", "The", "#", "|", "x" * 9]) for _ in range(n))


def test_words_lines_and_hashes():
    rng = random.Random(1)
    given = [None, "", " ", *(random_text(rng, rng.randint(0, 40)) for _ in range(300)), "w" * (3 << 20), "tail"]
    by_hash, by_line = {}, {}
    for size in (100, 1 << 21):
        for part in arrays.parts(pa.array(given), size):
            found, lines = arrays.words(part), arrays.lines(part)
            codes, raw = arrays.hashes(part, found, lower=True), part.data.tobytes()
            line_codes = arrays.hashes(part, lines)
            for i in range(len(part)):
                text = given[part.first + i] or ""
                a, b = found.bounds[i], found.bounds[i + 1]
                own = [raw[s:e].decode() for s, e in zip(found.start[a:b], found.end[a:b], strict=True)]
                assert own == words(text)
                for w, h in zip(own, codes[a:b].tolist(), strict=True):
                    assert by_hash.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), w), h) == h
                assert lines.bounds[i + 1] - lines.bounds[i] == text.count("\n") + 1
                for line, h in zip(text.split("\n"), line_codes[lines.bounds[i] : lines.bounds[i + 1]].tolist(), strict=True):
                    assert by_line.setdefault(line, h) == h
    assert len(set(by_hash.values())) == len(by_hash) and len(set(by_line.values())) == len(by_line)


def test_field_messages_equal_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        emission, pair = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        forward, backward = crf_quality.messages(emission, pair, np.array([0, n]))
        total, good = 0.0, np.zeros(n)
        for y in product((0, 1), repeat=n):
            w = np.exp(sum(emission[i] * y[i] for i in range(n)) + sum(pair[y[i], y[i + 1]] for i in range(n - 1)))
            total, good = total + w, good + w * np.array(y)
        assert np.allclose(good / total, 1 / (1 + np.exp(-(forward + backward))))


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op1_crf_quality"](spark, "/root/testdata/sf0.01").collect()
    label = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    held = [r for r in rows if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and len(rows) == 1000
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0


def test_language_of_held_out_documents(spark):
    rows = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows) and len(rows) == 1000
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held) > 0


def test_token_ids_equal_the_library():
    from tokenizers import Tokenizer

    rng, path = random.Random(5), tokenizer("byte_bpe_50k.json")
    bits = ["a", "b", "the", " ", "  ", "\n", "\xa0", " ", "\x85", "é", "×", "日本", "👍", "'s", "'ll", "12", ".", "<|endoftext|>", "|", "é's", "x|y"]
    given = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    given += texts().column("text").to_pylist()[:100]
    plain = Tokenizer.from_file(path)
    for remembered in (200, 10**6):
        tokens = packing.Tokens(path)
        tokens.memo.most = remembered
        for part in arrays.parts(pa.array(given), 1 << 15):
            ids, bounds = tokens.of(part)
            for i in range(len(part)):
                assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(given[part.first + i], add_special_tokens=False).ids


def test_packing_plan():
    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.choice([7, 10, 30, 1024])
        counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(0, min(capacity, 200)))}
        bins, seen = defaultdict(list), set()
        for length, first, n, sequence, offset in packing.plan(counts, capacity):
            for k in range(n):
                seen.add((length, first + k))
                bins[sequence + k].append((offset, length))
        assert seen == {(length, k) for length, n in counts.items() for k in range(n)}
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity and sum(3 * length > capacity for _, length in own) <= 2
        assert sorted(bins) == list(range(len(bins)))
    small = {length: 50 for length in range(1, 300)}
    n = len({s + k for _, _, m, s, _ in packing.plan(small, 1024) for k in range(m)})
    assert n <= 1.01 * sum(k * v for k, v in small.items()) / 1024 + 1


def test_packing_query(spark):
    rows = QUERIES["op2_best_fit_packing"](spark, SF).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 1024 for own in bins.values())
    assert len(bins) <= 1.15 * sum(r["length"] for r in rows) / 1024 + 1


def test_shared_passages_are_found(spark):
    given = texts()
    got = passages.passages(spark.createDataFrame(given.select(["doc_id", "text"]).to_pandas())).collect()
    ids, holders, codes = given["doc_id"].to_pylist(), defaultdict(set), {}
    for part in arrays.parts(given["text"].combine_chunks()):
        found = arrays.words(part)
        own = arrays.hashes(part, found, lower=True)
        runs, bounds = arrays.runs(own, found.bounds, passages.MIN_WORDS)
        for i in range(len(part)):
            codes[ids[part.first + i]] = own[found.bounds[i] : found.bounds[i + 1]]
            for j, run in enumerate(runs[bounds[i] : bounds[i + 1]].tolist()):
                if len(set(codes[ids[part.first + i]][j : j + passages.MIN_WORDS].tolist())) > 10:
                    holders[run].add(ids[part.first + i])
    want = {i for own in holders.values() if len(own) > 1 for i in own}
    named = {i for r in got for i in (r["doc_id"], r["other_doc_id"])}
    assert len(want) > 50 and want <= named
    for r in got:
        x = codes[r["doc_id"]][r["start_word"] : r["start_word"] + r["n_words"]]
        y = codes[r["other_doc_id"]][r["other_start_word"] : r["other_start_word"] + r["other_n_words"]]
        assert min(len(x), len(y)) >= passages.MIN_WORDS and passages.similarity(x, y) >= 0.8


def test_chains_are_the_best_ones():
    rng = random.Random(4)
    for _ in range(60):
        places = sorted({(rng.randint(0, 30), rng.randint(0, 30)) for _ in range(rng.randint(1, 9))})
        places = [p for i, p in enumerate(places) if p[0] not in {q[0] for q in places[:i]} and p[1] not in {q[1] for q in places[:i]}]
        a, b = (np.array(x) for x in zip(*places, strict=True))
        best = [0.0] * len(a)
        for i in range(len(a)):
            gaps = [best[j] - passages.GAP_COST * (a[i] + b[i] - a[j] - b[j] - 2 * passages.K) for j in range(i) if b[j] < b[i]]
            best[i] = passages.K + max([0.0, *gaps])
        got = passages.chain(a, b)
        assert sorted(i for c in got for i in c.tolist()) == list(range(len(a)))
        top = got[0]
        score = passages.K * len(top) - passages.GAP_COST * (a[top[-1]] + b[top[-1]] - a[top[0]] - b[top[0]] - 2 * passages.K * (len(top) - 1))
        assert abs(score - max(best)) < 1e-9


@pytest.mark.parametrize("share", [1, 1000])
def test_line_windows(spark, share):
    docs = table(spark, SF, "documents")
    rows = line_windows.trimmed(docs, heavy_share=share).select("row.doc_id", "text").collect()
    given = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert dict(rows) == trimmed_lines(given)


@pytest.mark.parametrize("most", [2, 4096])
def test_minhash_components(spark, most, monkeypatch):
    monkeypatch.setattr(minhash, "MOST_CLASSES", most)
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rng, more = random.Random(3), []
    base = [f"w{rng.randint(0, 500)}" for _ in range(80)]
    for i in range(40):  # a group whose links reach over several steps
        base = [f"n{i}_{p}" if rng.random() < 0.025 else w for p, w in enumerate(base)]
        more.append((100_000 + i, " ".join(base)))
    docs = docs.union(spark.createDataFrame(more, docs.schema))
    given = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert got == near_components(given, 3, 85)


def test_estimates_follow_similarity():
    rng = np.random.default_rng(1)
    words_ = [f"w{i}" for i in range(1000)]
    for changed in (0, 5, 20, 60):
        a = list(rng.choice(words_, 300))
        b = [f"z{i}" if i < changed else w for i, w in enumerate(a)]
        part = next(arrays.parts(pa.array([" ".join(a), " ".join(b)])))
        bits = minhash._sketch(part, 3)["bits"].view("<u8")
        codes, bounds = minhash.distinct(*minhash.shingles(part, 3))
        x, y = set(codes[: bounds[1]].tolist()), set(codes[bounds[1] :].tolist())
        assert abs(minhash.estimates(bits[1:], bits[0])[0] - len(x & y) / len(x | y)) < 0.16


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (160, 100), (5, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 161)}}


def test_attach_keeps_all_rows(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, 0) for k in range(2, 30)], "k long, v long")
    right = spark.createDataFrame([(k, k * 10) for k in range(0, 20)], "k long, w long")
    got = sorted(tuple(r) for r in spread.attach(left, right, ["k"], ["v"]).select("k", "v", "w").collect())
    assert got == sorted((k, v, k * 10) for k, v in [(1, i) for i in range(500)] + [(k, 0) for k in range(2, 20)])


def test_rule_counts_equal_plain_counts():
    given = [*texts().column("text").to_pylist()[:150], None, "", "a b c d e a b c d e\n\nx\nx\n x", "#$ éé |"]
    for part in arrays.parts(pa.array(given), 1 << 14):
        counts, _ = tree_rules._measure(part)
        for i in range(len(part)):
            text = given[part.first + i] or ""
            own = words(text)
            lines = [x for x in text.split("\n") if words(x)]
            windows = Counter(tuple(own[j : j + 5]) for j in range(len(own) - 4))
            covered = {p for j in range(len(own) - 4) if windows[tuple(own[j : j + 5])] > 1 for p in range(j, j + 5)}
            want = [len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]
            assert counts[i].tolist() == want


def test_trees_are_monotone_and_flattened_rightly():
    rng = np.random.default_rng(3)
    x = rng.random((800, len(tree_rules.FEATURES)))
    j = tree_rules.FEATURES.index("symbol_share")
    model = tree_rules.boost(x, (x[:, j] + 0.3 * x[:, 0] + 0.2 * rng.random(800)) < 0.8)
    got = tree_rules.evaluate(model, x)
    for i in range(0, 800, 50):
        total = 0.0
        for node in model["roots"]:
            while model["left"][node] != node:
                node = model["left" if x[i, model["feature"][node]] <= model["cut"][node] else "right"][node]
            total += model["value"][node]
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-12
    steps = np.repeat(x[:50], 21, axis=0)
    steps[:, j] = np.tile(np.linspace(0, 1, 21), 50)
    assert (np.diff(tree_rules.evaluate(model, steps).reshape(50, 21), axis=1) <= 1e-12).all()


def test_decontamination_equals_all_windows():
    given = texts()["text"].combine_chunks().slice(0, 250)
    items = duckdb.sql("SELECT item_id, text FROM '/root/testdata/sf0.01/benchmark.parquet'").fetchall()
    rng = random.Random(6)
    edited = []
    for _, text in items[:20]:  # items with a few changed words inside other words
        own = words(text)
        own[rng.randrange(len(own))] = "changed"
        edited.append("some words before " + " ".join(own) + " and after")
    given = pa.array(given.to_pylist() + edited)
    benchmark = decontaminate.Benchmark([i for i, _ in items], [t for _, t in items])
    got = {}
    for part in arrays.parts(given):
        got.update({(part.first + r[0], r[1]): r[4] for r in benchmark.search(part, 0.8)})
    want = {}
    for part in arrays.parts(given):
        codes, bounds = decontaminate.word_codes(part)
        shingles, ends = arrays.runs(codes, bounds, 5)
        for item, size in enumerate(benchmark.sizes):
            known = set(benchmark.bags[item][1])
            for text in range(len(part)):
                own = shingles[ends[text] : ends[text + 1]].tolist()
                if not known & set(own):
                    continue
                n = size - 4
                best = max(benchmark.similarity(item, own[max(s, 0) : s + n]) for s in range(1 - n, len(own)))
                if best >= 0.8:
                    want[part.first + text, item] = best
    assert len(want) > 10 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(8)
    prints = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    length = decontaminate.Length(9, list(range(60)), prints, decontaminate.RADIUS)
    asked = prints[rng.integers(0, 60, 400)]
    for _ in range(22):
        asked = asked ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) * (rng.random(400) < 0.8).astype(np.uint64)
    window, item = length.near(asked)
    want = np.argwhere(np.bitwise_count(asked[:, None] ^ prints[None, :]) <= decontaminate.RADIUS)
    assert sorted(zip(window.tolist(), item.tolist(), strict=True)) == [tuple(x) for x in want.tolist()]


def test_chat_escapes_can_be_undone():
    rng, template = random.Random(1), chat.INSTRUCTION
    escape = chat.escaper(template)
    bits = [*template.controls(), "\\", "[", "<", "/", "s>", "INST]", "a", " ", "\n", "</", "<<", ">>", "é"]
    for _ in range(3000):
        turns = []
        for _ in range(3):
            text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 7)))
            assert chat.unescape(escape(text)) == text and not any(c in escape(text) for c in template.controls())
            turns.append((rng.choice(["user", "assistant", "system", "to<<ROLE>>ol", ""]), text))
        formatted = ""
        for role, text in turns:
            a, b, c = template.other
            turn = template.turns.get(role) or chat.Turn(a + escape(role) + b, c)
            formatted += turn.head + escape(text) + turn.tail
        assert list(chat.Reader(template).feed(formatted, True)) == turns


def test_automaton_equals_greedy_matching():
    rng = random.Random(3)
    for _ in range(120):
        entries = {bytes(rng.choice(b" abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 14))}
        automaton = piece_counts.Automaton.build(entries)
        given = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(40)]
        end = np.cumsum([len(w) for w in given])
        start = end - [len(w) for w in given]
        got = automaton.counts(np.frombuffer(b"".join(given), np.uint8), start, end)
        assert got.tolist() == [greedy_pieces(b" " + w, entries, 6) for w in given]


def test_piece_count_query(spark):
    rows = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op10_piece_counts"](spark, SF).collect()}
    entries = set(piece_counts.vocabulary(tokenizer("byte_bpe_50k.tiktoken")))
    assert entries <= set(piece_counts.vocabulary(tokenizer("byte_bpe_50k.json")))
    longest = max(map(len, entries))
    given = texts("sf0.001")
    for i, text in zip(given["doc_id"].to_pylist()[:40], given["text"].to_pylist()[:40], strict=True):
        assert rows[i] == sum(greedy_pieces(b" " + w.encode(), entries, longest) for w in words(text))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, cursor.fetchall()))


def test_families_are_found():
    assert language.FAMILIES["germanic"] and len({c for f in language.FAMILIES.values() for c in f}) == sum(map(len, language.FAMILIES.values()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    given = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.quality_rules(spark, docs, SF).cache()
    assert kept.columns == docs.columns
    model = tree_rules.fit(docs, table(spark, SF, "labels"))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in tree_rules.verdicts(docs, model).filter("kept").collect()}
    lines = corpus_pipeline.line_dedup(spark, kept, SF).cache()
    want = {i: t for i, t in trimmed_lines([(r["doc_id"], r["text"]) for r in kept.collect()]).items() if words(t) or t == given[i]}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    near = corpus_pipeline.near_dedup(spark, lines, SF).cache()
    root = near_components(list(want.items()), 5, 80)
    assert {r["doc_id"] for r in near.collect()} == {i for i in want if root[i] == i}
    clean = corpus_pipeline.decontamination(spark, near, SF).cache()
    hit = {r["doc_id"] for r in decontaminate.links(near, table(spark, SF, "benchmark")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in near.collect()} - hit
    packed = corpus_pipeline.best_fit_packing(spark, clean, SF).collect()
    whole = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
    assert whole == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect())
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean.collect()}


def test_passages_of_common_blocks(spark):
    """Two texts share 80 words made of two blocks of 40 that each stand alone in many others."""
    rng = random.Random(5)
    word = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows, pairs = [], set()
    for trial in range(6):
        one, two = word(40), word(40)
        own = [one + two, one + two, *([one] * 40), *([two] * 40)]
        ids = [trial * 100 + i for i in range(len(own))]
        rng.shuffle(ids)
        pairs.add((max(ids[:2]), min(ids[:2])))
        rows += [(i, " ".join(word(60) + shared + word(60))) for i, shared in zip(ids, own, strict=True)]
    got = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in got} == pairs
    assert all(80 <= r["n_words"] <= 81 for r in got)


def test_decontamination_does_not_depend_on_blocks(spark):
    rng = random.Random(3)
    shared = [f"c{i}" for i in range(12)]
    items = [[f"w{rng.randrange(10**9)}" for _ in range(20)] + (shared if i % 3 else shared[:7]) for i in range(24)]
    docs = []
    for i, item in enumerate(items):
        own = list(item)
        own[rng.randrange(4)] = "changed"
        docs.append((i, " ".join(["before"] * 8 + own + items[(i + 1) % 24][:9])))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    one, many = (
        sorted((*r[:4], round(r[4], 9)) for r in decontaminate.links(docs, bench, 0.5, size).collect()) for size in (4096, 2)
    )
    assert one == many and len(one) >= 24
    kept = [{r["doc_id"] for r in decontaminate.clean(docs, bench, 0.7, size).collect()} for size in (4096, 2)]
    assert kept[0] == kept[1]
