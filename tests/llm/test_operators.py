"""Operators held against brute force on small tables with awkward rows."""

import bisect
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebar.llm import chat, exact_dedup, id_store, jaccard_join, media, mixing, packing, queries
from tidebar.llm import suffix_dedup, token_counts, toxicity
from tidebar.llm.common import Scratch
from tidebar.llm.encoder import vocabulary_path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, text_hash string"


def awkward():
    """Nulls, empty and long texts, ties, repeated rows; columns named as the operators name theirs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "er", "éô", "th", "x"]) for _ in range(rng.randint(1, 4)))
    prose = [" ".join(word() for _ in range(rng.randint(1, 120))) + rng.choice(["", ".", "\n"]) for _ in range(60)]
    long = " ".join(word() for _ in range(30_000))
    near = [prose[0] + " " + prose[1] + f" tail{k}" for k in range(12)]
    passage = prose[2] * 3
    texts = [None, "", " \n\t", "a", "a", long, long, "x" * 5000, "日本語 テキスト。 <|endoftext|> é É", "a b\x1cc　d"]
    texts += prose + prose[:7] + near + [prose[3] + passage + prose[4], passage, prose[5] + passage] + [long[5000:60_000]]
    rows = [(k * 7 % 101, t, "en", f"s{k % 4}" if k % 5 else None, 1, 3, "no") for k, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, prose[6], None, None, None, None, None), (None, None, None, "s1", 0, 0, "")]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def small(spark):
    return queries.table(spark, SMALL, "documents")


def collected(frame):
    return [r.asDict(recursive=True) for r in frame.collect()]


@pytest.mark.parametrize("hash_bytes", [16, 1])
def test_exact_dedup(spark, docs, rows, hash_bytes):
    found = collected(exact_dedup.exact_dedup(docs, hash_bytes=hash_bytes))
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(found) == len(rows)
    for r in found:
        ids = by_hash[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((x for x in ids if x is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in found) == len(groups)


def test_mixing(spark, docs, rows):
    found = collected(mixing.mix(docs))
    assert found and sorted(map(str, found)) == sorted(map(str, collected(mixing.mix(docs))))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len([w for w in (r[1] or "").encode().split()])
    taken = defaultdict(int)
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    order = sorted([s for s in sizes if s is not None]) + [None]
    left, budget, goal = list(order), 1.5 * sum(sizes.values()), {}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    while True:
        unit = budget / sum(weight[s] for s in left) if left else 0
        over = [s for s in left if unit * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2 * sizes[s]
            budget -= goal[s]
            left.remove(s)
    goal |= {s: unit * weight[s] for s in left}
    for r in found:
        assert r["target"] == pytest.approx(goal[r["source"]])
    for s, t in goal.items():
        assert taken[s] == int(t + 1e-6) or abs(taken[s] - t) <= 1
    queue = mixing.packets(docs)
    brute_queue(collected(queue), goal, {r["row"]: r["taken"] for r in found})
    total = sum(taken.values())
    served = [r.asDict() for r in mixing.mixed_order(queue, total, words_per_range=500).collect()]
    assert sum(r["words"] for r in served) == total
    finish = [r["finish"] for r in served]
    assert finish == sorted(finish) and [r["at"] for r in served] == sorted(r["at"] for r in served)
    assert mixing.mixed_order(queue, total, words_per_range=500).rdd.getNumPartitions() == -(-total // 500)


def brute_queue(queue, goal, taken):
    """Serves packets by virtual finish time, one after another, until the budget is gone."""
    budget, got = sum(int(t) for t in goal.values()), Counter()
    streams = defaultdict(list)
    for r in queue:
        streams[r["source"]].append(r)
    for source, own in streams.items():
        own.sort(key=lambda r: (r["finish"] or 0, r["pass"], r["first"]))
        words = 0
        for r in own:
            words += r["length"]
            if r["length"]:
                assert r["finish"] == pytest.approx(words / goal[source])
    for r in sorted(queue, key=lambda r: (r["finish"] or 0, r["at"])):
        words = min(r["length"], budget)
        budget -= words
        got[r["row"]] += words
        assert r["words"] == words
    assert budget == 0 and dict(got) == taken


def encoded(texts, end):
    library = Tokenizer.from_file(vocabulary_path())
    return [library.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(found, texts_by_id):
    ids = {k: encoded([t], 2)[0] for k, t in texts_by_id.items()}
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert crc(own[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        per_doc[r["doc_id"]].append((r["start"], r["length"]))
        per_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, pieces in per_doc.items():
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == len(ids[k])
    padding = total = 0
    for pieces in per_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.01 * total
    assert len(per_doc) == len(texts_by_id)


def test_packing(spark, docs, rows):
    kept = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    check_packing(collected(packing.pack(kept, run_tokens=20_000)), texts)
    check_packing(collected(packing.pack(small(spark))), {r["doc_id"]: r["text"] for r in small(spark).collect()})
    assert any(r["doc_id"] is None for r in collected(packing.pack(docs)))


def test_packing_is_the_cheapest_chain():
    """Packer.windows against all cut sets, whose last window may also be cut into powers of two."""
    rng = random.Random(1)
    for _ in range(300):
        most, fee, inside, anywhere = rng.choice([8, 12, 16, 32]), rng.choice([0.5, 3.0, 7.0]), 1.0, rng.choice([1.0, 5.0])
        packer = packing.Packer(most, inside, anywhere, most // 2, fee)
        sentences = np.cumsum([rng.randint(1, most) for _ in range(rng.randint(1, 5))])
        docs = np.array(sorted({*rng.sample(sentences.tolist(), rng.randint(1, len(sentences))), int(sentences[-1])}))
        places, penalty = packer.places(docs, sentences)
        at, known = places.tolist(), dict(zip(places.tolist(), penalty.tolist(), strict=True))
        window = lambda n: min(most - n, fee if n < most and n & (n - 1) == 0 else np.inf) if n <= most else np.inf
        tail = lambda n: fee * len(packing.powers(n)) + anywhere * (len(packing.powers(n)) - 1) if n <= most else np.inf

        def cost(head, end):
            steps = [b - a for a, b in zip([0, *head], head, strict=False)]
            last = end - (head[-1] if head else 0)
            return sum(map(window, steps)) + sum(known[b] for b in [*head, end]) + min(window(last), tail(last))

        inner = at[1:-1]
        best = min(cost([p for k, p in enumerate(inner) if mask >> k & 1], at[-1]) for mask in range(1 << len(inner)))
        ends = packer.windows(docs, sentences)
        assert ends == sorted(set(ends)) and ends[-1] == at[-1]
        found = []
        for k in range(len(ends)):
            head, rest = ends[:k], [b - a for a, b in zip([0, *ends][k:], ends[k:], strict=False)]
            if all(p in known for p in head) and (len(rest) == 1 or rest == packing.powers(sum(rest))):
                steps = [b - a for a, b in zip([0, *head], head, strict=False)]
                own = min(window(rest[0]), tail(rest[0])) if len(rest) == 1 else tail(sum(rest))
                found.append(sum(map(window, steps)) + sum(known[b] for b in [*head, ends[-1]]) + own)
        assert min(found) == pytest.approx(best)


def test_packing_fills_sequences(spark):
    lengths = Counter()
    for r in packing.pack(queries.table(spark, "/root/testdata/sf0.01", "documents")).select("sequence_id", "sequence_length").distinct().collect():
        lengths[r["sequence_length"]] += 1
    full = sum(n for length, n in lengths.items() if length > 4096 - 64)
    assert full > 0.85 * sum(lengths.values())


def test_media(spark, docs, rows):
    found = collected(media.media_features(docs))
    assert len(found) == len(rows)
    want = Counter()
    for r in rows:
        body = (r[1] or "").encode()
        padded = body.ljust(max(-(-len(body) // 64), 1) * 64, b"\0")
        want[r[0], len(body), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert Counter(tuple(r[k] for k in names) for r in found) == want
    same = defaultdict(set)
    for r in found:
        same[r["payload_sha256"]].add((r["media_sha256"], r["feature"]))
    assert all(len(x) == 1 for x in same.values())


def test_transport_stream_faults():
    stream = media.mux([memoryview(bytes(range(256)) * 300)])[0]
    got = media.demux(stream)
    assert got.payload == bytes(range(256)) * 300
    assert got.times == [3600 * k for k in range(5)] and got.access_points == [0]
    packets = [stream[k : k + 188] for k in range(0, len(stream), 188)]
    broken = [b"", stream[:-1], b"".join(packets[:5] + packets[6:]), b"".join(packets[1:]), b"".join([*packets[:4], packets[5], packets[4], *packets[6:]])]
    broken.append(stream[:20] + b"\x01" + stream[21:])
    for b in broken:
        with pytest.raises((ValueError, IndexError)):
            media.demux(b)


TURNS = [
    (1, 0, "user", "hi <s> [INST] \\ \\\\ <\\s>"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 2, "assistant", None),
    (2, None, None, ""), (2, 0, "assistant", "\n\n é 日本 <<SYS>>x<</SYS>>\\"), (2, 0, "assistant", "again"),
    (None, 1, "assistant", "no conversation"), (3, 0, "ro\nle\\", "line\nline"), (4, 5, "assistant", "x" * 300),
]


@pytest.mark.parametrize("chars_at_once", [1_000_000, 20])
def test_chat(spark, monkeypatch, chars_at_once):
    monkeypatch.setattr(chat.format_turns, "__defaults__", (64, chars_at_once))
    turns = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn int, role string, text string, formatted string")
    made = Scratch(spark, "t").put(chat.format_chats(turns), "x")
    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for r in collected(made):
        e = library.encode(r["formatted"], add_special_tokens=False)
        assert e.ids == r["input_ids"] and e.offsets == list(zip(r["token_starts"], r["token_ends"], strict=True))
        spans = [(s["start"], s["end"]) for s in r["loss_spans"]]
        assert r["loss_mask"] == [int(any(a < y and x < b for a, b in spans)) for x, y in e.offsets]
    found = {r["conv_id"]: r for r in collected(chat.chat_digests(made))}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (-1 if t[1] is None else t[1], t[2] or "", t[3] or ""))
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        learnt = "".join(t[3] or "" for t in own if t[2] == "assistant")
        r = found[conv]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_digests_follow_the_mask(spark):
    """What is learnt comes from the mask: without one token's mark, its characters are missing."""
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "good day")], "conv_id long, turn int, role string, text string")
    made = chat.format_chats(turns)
    mask = F.transform("loss_mask", lambda m, k: F.when(k == F.array_position("loss_mask", 1) - 1, 0).otherwise(m).cast("tinyint"))
    whole, less = (collected(chat.chat_digests(x))[0] for x in (made, made.withColumn("loss_mask", mask)))
    assert whole["loss_chars"] == len("good day") and less["loss_sha256"] == hashlib.sha256(b" day").hexdigest()


def test_learnt_runs():
    """Against a set of characters, with tokens that share characters and tokens over several spans."""
    rng = random.Random(2)
    for _ in range(300):
        edges = sorted(rng.sample(range(40), 2 * rng.randint(0, 4)))
        spans = np.array(edges, np.int64).reshape(-1, 2)
        begin = np.array(sorted(rng.randint(0, 36) for _ in range(rng.randint(0, 12))), np.int64)
        end = np.maximum.accumulate(begin + np.array([rng.randint(0, 9) for _ in begin], np.int64)) if len(begin) else begin
        mask = chat.token_mask(begin, end, spans[:, 0], spans[:, 1])
        inside = {c for a, b in spans.tolist() for c in range(a, b)}
        for a, b, m in zip(begin.tolist(), end.tolist(), mask.tolist(), strict=True):
            assert a == b or m == bool(inside & {*range(a, b)})
        runs = chat.learnt(begin, end, mask, spans[:, 0], spans[:, 1])
        want = {c for a, b in zip(begin.tolist(), end.tolist(), strict=True) for c in range(a, b)} & inside
        assert [c for a, b in runs for c in range(a, b)] == sorted(want)


def damaged(spark, root, name, column, value):
    """The store at ``root`` with one row's ``column`` of the table ``name`` changed, as a new store."""
    to = Scratch(spark, "t").path("damaged")
    for t in ("chunks", "recipes", "manifests"):
        frame = spark.read.parquet(f"{root}/{t}")
        if t == name:
            first = frame.orderBy(*(c for c in ("start", "digest", "file") if c in frame.columns)).first()
            key = "digest" if t == "chunks" else "row" if t == "recipes" else "file"
            frame = frame.withColumn(column, F.when(F.col(key) == F.lit(first[key]), value).otherwise(F.col(column)))
        frame.write.parquet(f"{to}/{t}")
    return to


def test_id_store_finds_damage(spark, docs):
    root = Scratch(spark, "t").path("store")
    id_store.write_store(docs, root, bits=4, least=33, most=200, rows_per_file=20)
    zeros = F.unhex(F.repeat(F.lit("00"), 32))
    for name, column, value in (("recipes", "root", zeros), ("manifests", "root", zeros), ("manifests", "tokens", F.lit(1).cast("long"))):
        with pytest.raises(Exception, match="root|manifests"):
            id_store.verify(spark, damaged(spark, root, name, column, value))
    with pytest.raises(Exception, match="does not match its digest"):
        id_store.read_back(spark, damaged(spark, root, "chunks", "ids", F.concat("ids", zeros))).collect()
    with pytest.raises(Exception, match="not stored|does not match"):
        id_store.read_ids(spark, damaged(spark, root, "chunks", "digest", zeros)).collect()


def test_other_vocabularies(spark, docs, rows):
    """A vocabulary with other rules is encoded in whole-text calls."""
    path = vocabulary_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    root = Scratch(spark, "t").path("store")
    id_store.write_store(docs, root, end_id=70_000, path=path)
    want = Counter((r[0], tuple([*library.encode(r[1] or "", add_special_tokens=False).ids, 70_000])) for r in rows)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in collected(id_store.read_ids(spark, root))) == want
    id_store.verify(spark, root)
    found = Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in collected(id_store.read_back(spark, root)))
    assert found == Counter((k, len(e), crc(e)) for k, e in want.elements())


def test_id_store(spark, docs, rows):
    root = Scratch(spark, "t").path("store")
    id_store.write_store(docs, root, bits=4, least=33, most=200, rows_per_file=20)
    id_store.verify(spark, root)
    found = collected(id_store.read_back(spark, root))
    want = Counter((r[0], len(e), crc(e)) for r, e in zip(rows, encoded([r[1] for r in rows], 1), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == want
    rebuilt = collected(id_store.read_ids(spark, root))
    assert Counter((r["doc_id"], len(r["ids"]), crc(r["ids"])) for r in rebuilt) == want
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    chunks = spark.read.parquet(f"{root}/chunks")
    assert chunks.count() == chunks.select("ids").distinct().count()


def test_token_counts(spark, docs, rows):
    library = Tokenizer.from_file(vocabulary_path())
    for rule in token_counts.RULES:
        want = Counter()
        for r in rows:
            text = r[1] or ""
            edges = [0] + [k + 1 for k, c in enumerate(text) if c in ".!?\n"]
            edges = sorted({e for e in edges if e < len(text)})
            spans = library.encode(text, add_special_tokens=False).offsets
            of = lambda x, edges=edges: bisect.bisect_right(edges, x) - 1
            counts, crossing = [0] * len(edges), 0
            for a, b in spans:
                x, y = of(a), of(max(b - 1, a))
                crossing += x != y
                share = Counter(of(c) for c in range(a, b)) if rule == "most" and x != y else {x: 1}
                counts[y if rule == "last" else max(share, key=lambda s: (share[s], -s))] += 1
            want[r[0], len(text), len(spans), crossing, tuple(counts)] += 1
        found = Counter(
            (r["doc_id"], r["n_chars"], r["n_tokens"], r["n_crossing"], tuple(r["section_tokens"]))
            for r in collected(token_counts.count_sections(docs, rule=rule))
        )
        assert found == want


def brute_classes(rows, n=5, num=4, den=5):
    texts = sorted({r[1] or "" for r in rows})
    grams = []
    for t in texts:
        w = t.split()
        grams.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links, root = [0] * len(texts), list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both and both * den >= num * len(grams[i] | grams[j]):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for r in rows:
        if r[0] is not None:
            c = top(texts.index(r[1] or ""))
            least[c] = min(least.get(c, r[0]), r[0])
    return {t: (least.get(top(k)), links[k]) for k, t in enumerate(texts)}


@pytest.mark.parametrize("block_docs", [1500, 3])
def test_jaccard_join(spark, docs, rows, block_docs):
    want = brute_classes(rows)
    copies = Counter(r[1] or "" for r in rows)
    expected = Counter((r[0], *want[r[1] or ""], copies[r[1] or ""]) for r in rows)
    found = collected(jaccard_join.jaccard_join(docs, block_docs=block_docs))
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in found) == expected


def test_jaccard_join_on_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    want = brute_classes(rows)
    found = collected(queries.op9_jaccard_join(spark, "/root/testdata/sf0.01"))
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in found} == {(r[0], *want[r[1] or ""]) for r in rows}


def test_overlaps_agree():
    rng = np.random.default_rng(3)
    for m, grams, n in ((5, 40, 60), (40, 30, 900), (3, 3, 0)):
        pairs = np.unique(np.stack([rng.integers(0, m, n), rng.integers(0, grams, n)]), axis=1)
        sets = [set(pairs[1][pairs[0] == k].tolist()) for k in range(m)]
        got = jaccard_join.overlaps(pairs[0], pairs[1].astype(np.uint64), m, most_pairs=50)
        assert all(got[i, j] == len(sets[i] & sets[j]) for i in range(m) for j in range(m) if i != j)


def brute_repeats(rows, width=50):
    first = {}
    key = lambda x: (x is not None, x or 0)
    bodies = [(r[0], (r[1] or "").encode()) for r in rows]
    for d, b in bodies:
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            if w not in first or key(d) < key(first[w]):
                first[w] = d
    out = Counter()
    for d, b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if key(first[b[k : k + width]]) < key(d):
                gone[k : k + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(spark, docs, rows, hot):
    found = collected(suffix_dedup.remove_repeats(docs, hot=hot, bucket_bytes=20_000))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[k] for k in names) for r in found) == brute_repeats(rows)
    for r in found:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_suffix_dedup_on_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()]
    found = collected(queries.op10_suffix_dedup(spark, "/root/testdata/sf0.01"))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r[k] for k in names) for r in found) == brute_repeats(rows)


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    up = labels == 1
    return (order[up].sum() - up.sum() * (up.sum() + 1) / 2) / (up.sum() * (~up).sum())


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    found = {r["doc_id"]: r for r in queries.op2_toxicity(spark, sf).collect()}
    labels = queries.table(spark, sf, "labels").collect()
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    held = [(found[r["doc_id"]], r["toxic"]) for r in labels if found[r["doc_id"]]["held_out"]]
    y = np.array([t for _, t in held])
    assert auc(np.array([r["score"] for r, _ in held]), y) > 0.95
    said = np.array([r["predicted"] for r, _ in held])
    assert (said[y == 0]).mean() < 0.02 and said[y == 1].mean() > 0.75


def test_toxicity_of_awkward_rows(spark, docs, none, rows):
    labels = spark.createDataFrame([(7, 1), (7, 0), (14, None), (21, 0), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "toxic")
    scored = collected(toxicity.score(docs, model))
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(none, model).count() == 0
    blank = toxicity.train(docs, labels.limit(0), "toxic")
    assert {r["score"] for r in collected(toxicity.score(docs, blank))} == {0.5}


def test_empty_tables(spark, none):
    assert exact_dedup.exact_dedup(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack(none).count() == 0
    assert media.media_features(none).count() == 0
    assert token_counts.count_sections(none).count() == 0
    assert jaccard_join.jaccard_join(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.chat_digests(chat.format_chats(turns)).count() == 0
    root = Scratch(spark, "t").path("empty")
    id_store.write_store(none, root)
    id_store.verify(spark, root)
    assert id_store.read_back(spark, root).count() == 0


def test_sql_agrees(spark):
    """The operators with SQL, on a small table."""
    base = duckdb.connect()
    for name in ("documents", "conversations"):
        base.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        if name not in queries.QUERIES:
            continue
        frame = queries.QUERIES[name](spark, SMALL)
        cols = sorted(frame.columns)
        want = base.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in frame.select(*cols).collect())


def test_texts_are_exchanged_by_key_at_any_size(spark):
    """Few members were broadcast and many exchanged, so the exchange grew faster than the documents."""
    source = spark.createDataFrame([(1, b"a", "x"), (2, b"b", "y")], "doc_id long, text_hash binary, text string")
    members = spark.createDataFrame([(b"a", 1, 7, 7, 0, 0, 0)], "text_hash binary, rep_id long, node long, root long, block long, one long, two long")
    found = jaccard_join._with_texts(source, members)
    assert [(r.node, r.text) for r in found.collect()] == [(7, "x")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
