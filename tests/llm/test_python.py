"""Packing, decontamination, archives, token files, near duplicates and chats against brute force."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberlog.llm import _store, chat, decontamination, near_dedup, packing, token_frames, warc
from emberlog.llm._tokens import default_tokenizer, encoder
from emberlog.llm._words import Shingles

DOCS = "doc_id long, text string, part int, name string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)


def some_texts():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("al", "en", "or", "ux", "is")]
    texts = [None, "", " \n ", "one", "  two  spaces\n\n and\ttabs ", "é ü 😀 <|endoftext|> don't", "x" * 5000]
    return texts + [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 900))) for _ in range(40)]


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_packing(spark, plain_ids):
    texts = some_texts()
    frame = docs(spark, [*enumerate(texts), (None, "null id")]).repartition(3)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in packing.pack(frame).collect():
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in [*enumerate(texts), (None, "null id")]:
        ids, at = [*plain_ids(text), 0], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, crc(ids[at : at + r["length"]]), len(ids))
            at += r["length"]
        assert at == len(ids)
    for k, parts in by_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or k == max(by_seq)
    made = packing.sequences(packing.token_table(frame)).collect()
    assert {r["sequence_id"] for r in made} == set(by_seq) and all(r["length"] == 1024 for r in made if r["sequence_id"] < max(by_seq))
    assert packing.pack(docs(spark, [])).count() == 0


def test_token_files(spark, plain_ids, tmp_path):
    texts = some_texts()
    frame, path = docs(spark, enumerate(texts)), str(tmp_path / "tokens")
    token_frames.write(frame, path, file_tokens=4000)
    at = 0
    for r in sorted(token_frames.describe(spark, path).collect(), key=lambda r: r["doc_id"]):
        ids = [*plain_ids(texts[r["doc_id"]]), 2]
        assert tuple(r)[1:] == (at, len(ids), crc(ids))
        at += len(ids)
    wanted = {r["doc_id"]: list(r["ids"]) for r in token_frames.read(spark, path, [3, 20]).collect()}
    assert wanted == {i: [*plain_ids(texts[i]), 2] for i in (3, 20)}
    assert token_frames.round_trip(docs(spark, [])).count() == 0
    assert token_frames.round_trip(docs(spark, [(None, "a"), (5, "b"), (5, "b")])).count() == 3


def test_ids_are_those_of_the_tokenizer_as_loaded():
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(default_tokenizer())
    end = "<|endoftext|>"
    texts = [*some_texts(), f"a {end} b", end, f"{end}{end}", f" {end}  x\n{end}\n", f"one two{end}three four. " * 50, "<|endoftext |> a", "<| endoftext|>"]
    made = [encoder(default_tokenizer()).ids(x) for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in made] == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(encoder(default_tokenizer()).ids(f"a {end} b"), "<u4").tolist() == [64, 220, 50256, 275]


def test_damaged_frame():
    data = bytearray(token_frames.file_bytes(0, 0, [(1, b"\1\0\0\0" * 50)]) + token_frames.TAIL)
    assert list(token_frames.TokenFile(bytes(data)).documents()) == [(0, b"\1\0\0\0" * 50)]
    data[-9 - 24 + 8] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError):
        list(token_frames.TokenFile(bytes(data)).documents())


def letter_shingles(text, k=5):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_decontamination(spark):
    rng = random.Random(4)
    item = [" ".join(f"i{j}w{k}" for k in range(20)) for j in range(6)] + [None, "", "tiny item"]
    filler = lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    cut = lambda t, n: " ".join(t.split()[:n])
    texts = [None, "", filler(50), filler(3000) + " " + item[0].upper() + "! " + filler(10), cut(item[1], 16), cut(item[1], 17), cut(item[2], 18) + " " + filler(5), item[3] + " " + item[4], "Tiny, item", "a tiny item", item[5].replace("i5w10", "zz")]
    items = spark.createDataFrame([*enumerate(item)], "item_id long, text string")
    frame = docs(spark, [*enumerate(texts), (3, texts[3])])
    sets = [letter_shingles(t) for t in item]
    expected = {(i, j) for i, t in enumerate(texts) for j, q in enumerate(sets) if q and 100 * len(q & letter_shingles(t)) >= 80 * len(q)}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contained(frame, items).collect()} == expected and len(expected) > 5
    kept = decontamination.drop_contaminated(frame, items)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {i for i, _ in expected}
    assert decontamination.contained(frame, items.limit(0)).count() == 0 and decontamination.contained(docs(spark, []), items).count() == 0


def test_contaminated_rows_go_whatever_their_id(spark):
    item = " ".join(f"i{k}" for k in range(20))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    frame = docs(spark, [(None, f"a {item} b"), (None, "clean"), (5, item), (5, "clean too"), (6, None)])
    kept = decontamination.drop_contaminated(frame, items)
    assert kept.columns == frame.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(None, "clean"), (5, "clean too"), (6, None)}


def test_archives(spark, tmp_path):
    html = ["same", "same", None, "", "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n</p>", "big " * 20_000, "same"]
    rows = [(i, None if i == 1 else f"http://x.org/{i}\r\n é", h) for i, h in enumerate(html)] + [(6, "http://x.org/6", "same"), (None, "u", "same")]
    pages, path = spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "warc")
    warc.write(pages, path)
    out = warc.read(spark, path).collect()
    newest = {h or "": max(i for i, x in enumerate(html) if (x or "") == (h or "")) for h in html}
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] is not None:
            h = html[r["page_id"]] or ""
            first = newest[h] == r["page_id"]
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() and r["payload_bytes"] == len(h.encode())
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", newest[h]))
            assert r["payload"] == (h.encode() if first else None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def near_truth(texts, width, percent=80):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates(spark):
    rng = random.Random(8)
    texts = [None, "", " ", "A b c", "a  B\nc", "a b d"]
    for _ in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(60)]
        for _ in range(12):  # a chain: each copy differs from the one before in one word, so the ends are not alike
            base = list(base)
            base[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
            texts += [" ".join(base)] * rng.choice([1, 1, 2])
    frame = docs(spark, [*enumerate(texts), (8, texts[8]), (None, "z z z z z z")])
    truth = near_truth(dict(enumerate(texts)), 4)
    out = near_dedup.near_duplicates(frame, width=4).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == truth[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    kept = near_dedup.keep_one(frame, width=4)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == frame.columns and sorted(i for i in ids if i is not None) == sorted({c for _, c in truth.values()}) and None in ids
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_near_duplicates_without_or_with_repeated_ids(spark):
    words = lambda c: [f"{c}{k}" for k in range(60)]
    changed = lambda w, *at: " ".join("other" if k in at else x for k, x in enumerate(w))
    a, x, p, q = words("a"), words("x"), " ".join(words("p")), " ".join(words("q"))
    chain = [(1, changed(a)), (None, changed(a, 15)), (2, changed(a, 15, 45))]  # the ends are linked through the middle only
    nulls = [(None, changed(x)), (None, changed(x)), (None, changed(x, 15)), (None, changed(x, 15, 45))]
    repeated = [(3, p), (7, p), (7, q), (7, q), (8, ""), (8, ""), (None, None), (None, None)]
    frame = docs(spark, chain + nulls + repeated)
    ids = sorted(map(str, [r["component_id"] for r in near_dedup.near_duplicates(frame, width=4).where("n_shingles = 57").collect()]))
    assert ids == sorted(["1"] * 3 + ["None"] * 4 + ["3"] * 2 + ["7"] * 2)
    kept = near_dedup.keep_one(frame, width=4)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == frame.columns
    one = [r for r in rows if r in nulls]
    assert len(one) == 1 and sorted(map(str, (r for r in rows if r not in nulls))) == sorted(map(str, [(1, changed(a)), (3, p), (7, q), (8, ""), (None, None), (None, None)]))


def shuffled(spark, run):
    """Bytes that ``run()`` writes to shuffles, while no join is broadcast unless the code asks for it."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        seen = [-1]
        while len(seen) < 3 or len(set(seen[-3:])) > 1:  # the figures follow a moment later
            sc.listenerBus().waitUntilEmpty()
            found = sc.statusStore().executorList(True)
            seen.append(sum(found.apply(k).totalShuffleWrite() for k in range(found.size())))
            time.sleep(0.2)
        return seen[-1]

    before = total()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    return out, total() - before


def test_near_duplicates_shuffle_texts_not_their_sets(spark):
    rng = random.Random(5)
    texts = {}
    for k in range(30):
        words = [f"{rng.randrange(10**6)}" for _ in range(3000)]
        texts |= {2 * k: " ".join(words), 2 * k + 1: " ".join([*words[:-1], "end"])}
    frame = docs(spark, texts.items())
    out, moved = shuffled(spark, lambda: {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame, width=4).collect()})
    assert out == {i: i // 2 * 2 for i in texts}
    assert moved < 3 * sum(map(len, texts.values()))


def test_near_duplicates_of_divided_hubs(spark, monkeypatch):
    monkeypatch.setattr(_store, "LEAST_ROWS", 2)
    rng = random.Random(6)
    texts = []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
        texts += [" ".join("other" if k == at else w for k, w in enumerate(base)) for at in range(-1, 20)]
        texts += [" ".join(w if k < 52 else f"n{rng.randrange(10**6)}" for k, w in enumerate(base)) for _ in range(3)]
    truth = near_truth(dict(enumerate(texts)), 4)
    rows = near_dedup.near_duplicates(docs(spark, [*enumerate(texts), (3, texts[3])]), width=4).collect()
    assert len(rows) == len(texts) + 1 and all((r["n_shingles"], r["component_id"]) == truth[r["doc_id"]] for r in rows)


@pytest.mark.parametrize("bits", [1 << 23, 1 << 8, 64])
def test_keep_one_drops_rows_in_place(spark, monkeypatch, bits):
    monkeypatch.setattr(_store, "BITMAP_BITS", bits)
    rng = random.Random(7)
    wide = lambda: "".join(chr(rng.randrange(33, 127)) for _ in range(3000))
    words = " ".join(f"w{k}" for k in range(40))
    rows = [(i, words, 1, wide()) for i in range(200)] + [(i, f"one {i} alone", 1, "x") for i in range(200, 260)] + [(300, None, 1, "x"), (None, None, 1, "x"), (5, "another", 1, "x")]
    frame = spark.createDataFrame(rows, DOCS)
    out, moved = shuffled(spark, lambda: near_dedup.keep_one(frame, width=4).collect())
    assert sorted(map(str, out)) == sorted(str(r) for r in frame.collect() if r["text"] != words or r["doc_id"] == 0)
    if bits == 1 << 23:
        assert moved < 200 * 3000 / 2


def test_chats(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "\\### Assistant: </turn> ok"), (2, 5, "assistant", "a" * 1000 + "\n\\"), (2, 5, "assistant", "b"), (2, 5, "assistant", "b"), (2, 1, None, "<#:\\>"), (None, 0, "we:ird", "x")]
    rows += [(3, i, "assistant" if i % 2 else "user", "😀#" * 400) for i in range(120)]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, seq int")
    kinds = {r["operation"] for r in chat.events_of(frame).select("operation").distinct().collect()}
    assert kinds == set(chat.OPERATIONS)
    segments = chat.format_chats(frame)
    out = {r["conv_id"]: r for r in chat.digest(segments).collect()}
    parts = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        parts[r[0]].append(r)
    assert set(out) == set(parts) and segments.where("conv_id = 3").count() > 1
    for c, turns in parts.items():
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert out[c]["n_turns"] == len(turns) and out[c]["loss_chars"] == len(loss)
        assert out[c]["turns_sha256"] == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest()
        assert out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digest(chat.format_chats(frame.limit(0))).count() == 0


def test_log_folds_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, 0, "start", "user", None), (1, 0, 1, 1, "delta", None, "hel"), (1, 0, 1, 2, "delta", None, "lo"),
        (1, 1, 1, 3, "start", "assistant", None), (1, 1, 1, 4, "delta", None, "bad"), (1, 1, 1, 5, "regenerate", None, None), (1, 1, 1, 6, "delta", None, "good"),
        (1, 2, 1, 7, "start", "user", None), (1, 2, 1, 8, "delta", None, "x"), (1, 2, 1, 9, "edit", None, "y"), (1, 2, 1, 10, "delta", None, "z"),
        (1, 3, 1, 11, "start", "user", None), (1, 3, 1, 12, "remove", None, None),
        (1, 4, 1, 13, "start", "user", None), *[(1, 4, 1, 14, "delta", None, "once")] * 3, (1, 4, 1, 13, "start", "user", None), (1, 4, 1, 15, "delta", None, "!"),
        (1, 5, 1, 16, "start", "user", None), (1, 5, 1, 16, "delta", None, "lost"), (1, 5, 1, 17, "delta", None, "kept"),
    ]
    random.Random(1).shuffle(log)
    frame = spark.createDataFrame(log, "conv_id long, turn long, copy int, seq int, operation string, role string, text string")
    out = sorted((r["turn"], r["role"], r["text"]) for r in chat.reconstruct(frame).collect())
    assert out == [(0, "user", "hello"), (1, "assistant", "good"), (2, "user", "yz"), (4, "user", "once!"), (5, "user", "kept")]


@pytest.mark.parametrize("length", [60, 3000])
def test_block_pairs(length):
    """Blocks of a hub give every link between components once; for whole sets nothing else."""
    rng = random.Random(length)
    base = [rng.randrange(10**9) for _ in range(length)]
    texts = [[rng.randrange(10**9) if rng.random() < e else w for w in base] for e in (0.01, 0.02, 0.03, 0.05) for _ in range(12)]
    texts = [list(t) for t in dict.fromkeys(map(tuple, texts))]  # classes have different sets
    shingles = Shingles(4)
    sets = [shingles.of_words([str(w).encode() for w in t]) for t in texts]
    names, blocks = list(range(100, 100 + len(sets))), 3
    rows = []
    for k, s in enumerate(sets):
        sketch = (near_dedup.signature(s) & np.uint32(255)).astype(np.uint8).tobytes()
        wide = np.unique((s >> np.uint64(32)).astype(np.uint32))[: near_dedup.WIDE].tobytes()
        for other in range(blocks):
            x, y = sorted((k % blocks, other))
            rows.append({"hub": 1, "x": x, "y": y, "class_id": names[k], "part": k % 5, "n_shingles": len(s), "sketch": sketch, "wide": wide, "block": k % blocks})
    rows.sort(key=lambda r: (r["x"], r["y"]))
    batches = pa.Table.from_pylist(rows).to_batches(max_chunksize=7)
    found = [tuple(p.values()) for b in near_dedup.block_pairs(0.8, 1e-6)(iter(batches)) for p in b.to_pylist()]
    near = lambda p, q: 100 * len(np.intersect1d(p, q)) >= 80 * len(np.union1d(p, q))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if i % 5 != j % 5]
    links = {tuple(sorted((names[i], names[j]))) for i, j in pairs if near(sets[i], sets[j])}
    assert len(found) == len(set(found)) and links <= set(found) and 0 < len(links) < len(pairs)
    if length == 60:
        assert set(found) == links


def test_columns_of_any_name_and_settings_left_alone(spark):
    from emberlog.llm import quality_rules, secret_scan

    names = ["_text_key", "_row_id", "_row_key", "_maybe", "_gone", "_again", "_text_hash", "_spans", "_live", "_holds_item", "_failing_host", "doc", "host", "row", "m", "c", "base", "a.b"]
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(i, t, "en", f"s{i}", 9) for i, t in enumerate([None, "", good, good, f"{good} token=abcdef123456", "short"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.select("*", *[F.lit(7).alias(n) for n in names])
    items = spark.createDataFrame([(1, "no such item in any of the texts here")], "item_id long, text string")
    before = {k: v for k, v in spark.sparkContext.getConf().getAll()} | {r["key"]: r["value"] for r in spark.sql("set").collect()}
    stages = [quality_rules.keep_good, near_dedup.keep_one, lambda d: decontamination.drop_contaminated(d, items), secret_scan.redact]
    expected = [{2, 3, 4}, {0, 1, 2, 5}, set(range(6)), set(range(6))]
    for stage, ids in zip(stages, expected, strict=True):
        out = stage(frame)
        assert out.columns == frame.columns and {r["doc_id"] for r in out.collect()} == ids
        assert stage(frame.limit(0)).columns == frame.columns and stage(frame.limit(0)).count() == 0
    assert packing.pack(frame).count() >= 6
    assert before == {k: v for k, v in spark.sparkContext.getConf().getAll()} | {r["key"]: r["value"] for r in spark.sql("set").collect()}


def test_very_long_texts_are_worked_on_alone(spark, plain_ids):
    long = " ".join(f"word{k % 5000} and" for k in range(150_000))
    frame = docs(spark, [(1, long), (2, "short one"), (3, long + " end"), (4, None)])
    n = {r["doc_id"]: r["n"] for r in packing.pack(frame).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert n == {1: len(plain_ids(long)) + 1, 2: len(plain_ids("short one")) + 1, 3: len(plain_ids(long + " end")) + 1, 4: 1}
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}


def test_pipeline(spark, tmp_path, plain_ids):
    """Documents in, pieces out: each stage's decisions hold, also for null and repeated ids."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n))
    a, b, c, d, item = text(80), text(60), text(50), text(40), text(30)
    near = a.split()
    near[10] = "changed"
    rows = [(1, a), (2, a), (3, " ".join(near)), (4, b), (5, f"{text(500)} {item} {text(20)}"), (6, f"{c} password = hunter2hunter2"), (7, "too short"), (8, None), (9, ""), (None, d), (None, d), (4, b)]
    expected = [(1, a), (4, b), (6, f"{c} <SECRET>"), (None, d)]
    spark.createDataFrame([(i, t, "en", f"s{k % 5}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    parts = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        parts[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in parts.items()} == {i: [*plain_ids(t), 0] for i, t in expected}
