"""Each operator against a plain version, and on odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

import hashlib
import io
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from spoofscan.llm import fingerprints, line_dedup, media, mixing, packing, quality, queries, simhash, suffix_dedup, token_counts, tokens, toxicity
from spoofscan.llm.components import connected_components

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ["id", "row", "size", "copies", "rank", "uid", "fp", "ln", "bucket", "_c0", "place", "k1"]


def words(seed, n, most=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(most)}" for _ in range(n))


def rows():
    r = random.Random(3)
    out = [(i, words(i, r.randrange(1, 120)), "en", f"s{i % 4}", None) for i in range(60)]
    out += [(100 + i, out[i][1], None, None, 7) for i in range(10)]  # copies
    out += [(120 + i, out[20 + i][1] + " tail", "de", "s1", 0) for i in range(5)]  # near copies
    out += [(130, None, None, "s1", None), (131, "", "en", "s2", 0), (132, " \n\t ", "en", None, 4), (None, words(7, 30), None, "s0", None), (None, None, None, None, None)]
    out += [(5, out[5][1], "en", "s1", None)] * 2  # repeated rows
    out += [(140, words(9, 20_000), "en", "s3", None), (141, "\n".join(["a b c d"] * 30), "en", "s3", None), (142, "éßñ 日本 🎉 " * 40, "en", "s0", None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    table = spark.createDataFrame(rows(), SCHEMA)
    for name in CLASH:
        table = table.withColumn(name, table["lang"])
    return table.repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# --- 1 ---


def plain_print(text):
    tokens_ = (text or "").encode().lower().split()
    if not tokens_:
        return 0
    shingles = [b" ".join(tokens_[i : i + 3]) for i in range(max(1, len(tokens_) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    label = {x: x for x in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    known = sorted(label)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 3:
                label[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in known}


def test_simhash(docs, empty):
    want = [(i, plain_print(t)) for i, t, *_ in rows()]
    root = plain_components({p for _, p in want})
    least = defaultdict(lambda: None)
    for i, p in want:
        if i is not None:
            least[root[p]] = i if least[root[p]] is None else min(i, least[root[p]])
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((i, f"{p:016x}", least[root[p]]) for i, p in want)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    stay = Counter(root[plain_print(r["text"])] for r in kept.collect())
    assert stay == Counter(dict.fromkeys(root.values(), 1))
    assert all(least[root[plain_print(r["text"])]] == r["doc_id"] for r in kept.collect())


@pytest.mark.parametrize("most", [1 << 16, 40])
def test_links_among_fingerprints(spark, monkeypatch, most):
    """Dense groups, chains of links and strangers; with small keys too, which are split exactly."""
    r = random.Random(1)
    prints = {r.getrandbits(64) for _ in range(150)}
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(60):
            y = x
            for _ in range(r.randrange(0, 4)):
                y ^= 1 << r.randrange(64)
            prints.add(y)
            x = y if r.random() < 0.2 else x
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    monkeypatch.setattr(simhash, "MOST", most)
    if most < 1 << 16:  # the workers have the module's own limit: call the task's function here
        key = lambda p: [(i, (0xFFFF << 16 * i) | (0xFF << (16 * ((i + 1) % 4) + 8 * h))) for i in range(4) for h in range(2)]
        todo = [(i, m, p & m, p) for p in prints for i, m in key(p)]
        links = set()
        while todo:
            todo.sort()
            column = lambda k: np.array([x[k] for x in todo], np.uint64).view(np.int64)  # noqa: B023, E731
            batch = pa.record_batch({"start": pa.array([x[0] for x in todo], pa.int32()), "fixed": column(1), "bits": column(2), "fp": column(3)})
            todo, mask = [], (1 << 64) - 1
            for out in simhash._link([batch]):
                for x in out.to_pylist():
                    if x["b"] is None:
                        todo.append((x["start"], x["fixed"] & mask, x["bits"] & mask, x["a"] & mask))
                    else:
                        links.add((x["a"] & mask, x["b"] & mask))
    else:
        found = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()
        links = {(x.a & (1 << 64) - 1, x.b & (1 << 64) - 1) for x in found}
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    label = {p: p for p in prints}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        label[max(root(a), root(b))] = min(root(a), root(b))
    assert {p: root(p) for p in prints} == plain_components(prints)


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    for a, b in edges:
        if None not in (a, b) and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
            x, y = label[a], label[b]
            for k, v in label.items():
                if v == max(x, y):
                    label[k] = min(x, y)
    assert got == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2 and 6 ---


def test_twin_gives_the_library_s_ids():
    path, r = tokens.default_path(), random.Random(2)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "12", "'s", "'ll", "’", "—", "<|endoftext|>", "日", "🎉", "\x1c", "\xa0", "ß", "word", "Ελ", "...", "\x85", "\r\n", "ǆ", "\xad"]
    texts = ["".join(r.choices(parts, k=r.randrange(15))) for _ in range(5000)] + [words(1, 300)]
    want = [np.array(x.ids, "<u4").tobytes() for x in tokens.library(path).encode_batch(texts, add_special_tokens=False)]
    assert tokens.twin(path) and tokens.encode(path, texts) == want


def test_token_counts(spark, docs, empty, tmp_path):
    cache, library = str(tmp_path / "cache"), tokens.library(tokens.default_path())
    want = Counter((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in rows())
    for _ in range(2):  # the second time all counts come from the cache
        assert Counter(map(tuple, token_counts.token_counts(docs, cache).collect())) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t or "" for _, t, *_ in rows()})
    assert token_counts.token_counts(empty).count() == 0
    more = docs.limit(1).selectExpr("doc_id", "'a text that the cache lacks' AS text").union(docs.select("doc_id", "text"))
    assert token_counts.token_counts(more, cache).count() == len(rows()) + 1
    assert spark.read.parquet(cache).count() == len({t or "" for _, t, *_ in rows()}) + 1


def test_packing(docs, empty):
    path, got = tokens.default_path(), packing.pack(docs, window=64).toPandas()
    library = tokens.library(path)
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t, *_ in rows()]
    assert got["length"].sum() == sum(len(x) for _, x in ids)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 64
    assert (got.groupby("sequence_id")["length"].sum() < 64).sum() <= 5  # one a shard at most
    assert all(zlib.crc32(np.array(x, "<u4").tobytes()) == c for x, c in zip(got["ids"], got["ids_crc32"], strict=True))
    unique = {i: x for i, x in ids if Counter(k for k, _ in ids)[i] == 1}
    for key, own in got[got["doc_id"].isin(unique)].groupby("doc_id"):
        own = own.sort_values("start")
        assert [x for part in own["ids"] for x in part] == unique[key] and set(own["doc_tokens"]) == {len(unique[key])}
    assert packing.pack(empty).count() == 0


def test_neighbours_are_lexical():
    """Documents on one subject follow each other."""
    r = np.random.default_rng(0)
    shard = [(r.integers(0, 50, 30) + 1000 * (i % 4)).astype("<u4") for i in range(40)]
    order = [d for d, at, *_ in packing.pack_shard(shard, 64) if at == 0]
    assert sorted(order) == list(range(40))
    assert sum(a % 4 == b % 4 for a, b in zip(order[:-1], order[1:], strict=True)) > 30


# --- 3 and 8 ---


def auc(score, y):
    good, bad = score[y == 1], score[y == 0]
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


@pytest.mark.parametrize(("name", "label", "folds", "fold", "least"), [("op3_toxicity", "toxic", 4, 2, 0.8), ("op8_quality", "quality", 5, 0, 0.9)])
def test_classifiers(spark, name, label, folds, fold, least):
    at = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, at).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % folds == fold for i in got["doc_id"]]).all()
    both = got.merge(spark.read.parquet(f"{at}/labels.parquet").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) >= least


@pytest.mark.parametrize("operator", [toxicity.toxicity, quality.quality])
def test_classifiers_odd_rows(spark, docs, empty, operator):
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(None, 1, 1), (3, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    none = marks.filter("false")
    got = operator(docs, marks)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows())
    assert got.filter("score IS NULL OR isnan(score) OR held_out IS NULL").count() == 0
    assert operator(docs, none).count() == len(rows()) and operator(empty, marks).count() == 0


def test_drop_toxic_keeps_columns(spark, docs):
    marks = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == len(rows())


def test_ftrl_equals_its_formula():
    """Against a version that keeps a dictionary of coordinates and visits them one by one."""
    r = np.random.default_rng(5)
    given = [(np.unique(r.integers(0, 40, 12)) + 500 * (i % 3 == 0), int(i % 3 == 0)) for i in range(90)]
    z, n = defaultdict(float), defaultdict(float)
    positive = sum(y for _, y in given)
    bias, bias_n, order = math.log((positive + 1) / (len(given) - positive + 1)), 1.0, np.random.default_rng(7)

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for k in order.permutation(len(given)):
            at, y = given[k]
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y
            for i in w:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
            bias_n += g * g
            bias -= 0.1 * g / math.sqrt(bias_n)
    at, w, b = toxicity.fit(given)
    want = {i: weight(i) for i in list(z) if weight(i)}
    assert want and dict(zip(at.tolist(), np.round(w, 9).tolist(), strict=True)) == {i: round(x, 9) for i, x in sorted(want.items())}
    assert math.isclose(b, bias)


def test_network_equals_its_formula():
    """A probability from plain loops over positions, chunks and filters, for texts of every remainder."""
    r = np.random.default_rng(9)
    draw = lambda *shape: r.standard_normal(shape).astype(np.float32)
    model = {"table": draw(quality.TAPS, quality.SYMBOLS, quality.FILTERS), "bias": draw(quality.FILTERS), "mean": draw(quality.FILTERS), "max": draw(quality.FILTERS), "base": draw(1)}
    for size in (0, 1, 7, 8, 9, 100, 101, 255, 256, 257, 700):
        text = words(size, 200)[:size]
        x = quality.symbols(text)
        assert len(x) >= size and [int(v) & 255 for v in x[:size]] == list(text.encode()) and (len(x) - quality.TAPS) % quality.STRIDE == 0
        places = range(0, len(x) - quality.TAPS + 1, quality.STRIDE)
        response = [[model["bias"][f] + sum(model["table"][j, x[p + j], f] for j in range(quality.TAPS)) for f in range(quality.FILTERS)] for p in places]
        halves = [response[a : a + quality.HALF] for a in range(0, len(response), quality.HALF)]
        chunks = [halves[i] + halves[i + 1] for i in range(len(halves) - 1)] or halves
        top = [[max(0, max(row[f] for row in c)) for f in range(quality.FILTERS)] for c in chunks]
        a = sum(np.mean([t[f] for t in top]) * model["mean"][f] + max(t[f] for t in top) * model["max"][f] for f in range(quality.FILTERS)) + model["base"][0]
        assert math.isclose(quality.probability(model, text), 1 / (1 + math.exp(-max(-30, min(30, a)))), rel_tol=1e-3, abs_tol=1e-6)


def test_training_rows_are_bounded(spark):
    """A key that stands at many texts counts once; texts beyond the bound aren't learnt from."""
    from spoofscan.llm import learning

    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(50)] + [(8, "x" * 500)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    got = learning.training_rows(docs, marks, "toxic", 4, 2, 5, most_bytes=100).collect()
    assert len(got) <= 5 and len({x.id for x in got}) == len(got) and all(x.text == min(f"text {i}" for i in range(50) if i % 7 == x.id) for x in got)


# --- 4 ---


def test_fingerprints(docs, empty):
    given = sorted(((i, t or "") for i, t, *_ in rows()), key=lambda x: (x[0] is not None, x[0] or 0, xxhash.xxh64_intdigest(x[1].encode(), 42) >> 1))
    got = fingerprints.edited_fingerprints(docs).collect()
    want, distance = Counter(), []
    texts = [t for _, t in given]
    for k, (i, t) in enumerate(given):
        after, q = texts[(k + 1) % len(texts)], len(t) // 4
        want[i, len(t), sha((t[: len(t) - q] + after[:q]).encode())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by_text = defaultdict(set)
    for r in got:
        if r.doc_id is not None and r.doc_id != 5:
            by_text[next(t for i, t in given if i == r.doc_id)].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    assert {r.fingerprint for r in got if r.doc_id in (130, 131, 132)} == {"-"}
    for r in got:
        if r.doc_id is not None and r.doc_id != 5 and r.doc_id < 60:
            t = next(t for i, t in given if i == r.doc_id)
            k = given.index((r.doc_id, t))
            a, b = Counter(t.split()), Counter((t[: len(t) - len(t) // 4] + texts[k + 1][: len(t) // 4]).split())
            distance.append(r.near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(distance)) < 0.05 and np.std(distance) < 0.15
    assert fingerprints.edited_fingerprints(empty).count() == 0


def plain_signature(text):
    """Consistent weighted sampling as its formula says, a term and a sample at a time."""
    digest = lambda value, size, seed: xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=value < 0), seed)
    counts, out = Counter(xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split()), []
    unit = lambda bits, at: ((bits >> at & (1 << 21) - 1) + 0.5) / (1 << 21)
    for k in range(fingerprints.SAMPLES):
        best = None
        for h, n in counts.items():
            a = digest(k, 4, digest(h, 8, 42))
            b = digest(a, 8, 42)
            r, ln_c, shift = -math.log(unit(a, 0) * unit(a, 21)), math.log(-math.log(unit(a, 42) * unit(b, 0))), unit(b, 21)
            t = math.floor(math.log(n) / r + shift)
            found = (ln_c - r * (t - shift + 1), (h ^ t) & 65535)
            best = min(best, found) if best else found
        out.append(f"{best[1]:04x}")
    return "".join(out)


def test_fingerprint_equals_its_formula(spark):
    texts = [words(i, 5 + 30 * i, most=60) for i in range(4)] + ["one", "a a a b"]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: plain_signature(t) for i, t in enumerate(texts)}


def test_text_without_spaces_has_many_terms(spark):
    r = random.Random(6)
    texts = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(4000)) for _ in range(3)]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(0.35 < x.near_edited < 0.85 and x.near_next < 0.1 for x in got)


@pytest.mark.parametrize("levels", [(4, 3, 2), (6,), (5, 5)])
def test_ranges_rise_and_split_a_hot_key(spark, monkeypatch, levels):
    """Half of the rows have one id: they are dealt by their texts' hash, and ranges rise with id and hash."""
    monkeypatch.setattr(fingerprints, "LEVELS", levels)
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 40)
    given = [(7, f"t{i}") for i in range(600)] + [(i, f"u{i}") for i in range(500)] + [(None, f"n{i}") for i in range(90)]
    docs = spark.createDataFrame(given, "id long, text string").repartition(3)
    got = fingerprints._ranges(docs.selectExpr("*", "shiftrightunsigned(xxhash64(text), 1) AS h")).collect()
    order = sorted(got, key=lambda x: (x.id is not None, x.id or 0, x.h))
    assert [x.range for x in order] == sorted(x.range for x in order) and len(got) == len(given)
    hot = Counter(x.range for x in got if x.id == 7)
    assert len(hot) >= 3 and max(hot.values()) < 400
    nexts = fingerprints.with_next(docs).filter("NOT ghost").collect()
    after = {x.text: x.next for x in nexts}
    assert len(after) == len(given) and all(after[a.text] == b.text for a, b in zip(order, [*order[1:], order[0]], strict=True))


def test_fingerprint_needs_numbers(spark):
    with pytest.raises(ValueError, match="number"):
        fingerprints.edited_fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_fingerprint_of_a_lone_document(spark):
    got = fingerprints.edited_fingerprints(spark.createDataFrame([(4, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(got) == 1 and got[0].near_next == 1.0


# --- 5 ---


def test_text_media(docs, empty):
    got = media.text_media(docs).collect()
    want = Counter()
    for i, t, *_ in rows():
        data = (t or "").encode()
        payload = data.ljust(max(192, math.ceil(len(data) / 192) * 192), b" ")
        want[i, len(data), len(payload), sha(payload), zlib.crc32(payload[-16:])] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(sha(media.decode_netpbm(bytes(r.media)).tobytes()) == r.payload_sha256 for r in got)
    assert all(np.load(io.BytesIO(bytes(r.tile))).shape == (16, 16, 3) for r in got)
    assert media.text_media(empty).count() == 0


def bmp(pixels, bits):
    height, width = pixels.shape[:2]
    stride, table = (width * bits // 8 + 3) // 4 * 4, b""
    if bits == 8:
        table = bytes(x for v in range(256) for x in (v, v, v, 0))
        data = b"".join(r[:, 0].tobytes().ljust(stride, b"\0") for r in pixels[::-1])
    else:
        data = b"".join(np.concatenate([r[:, ::-1], np.zeros((width, bits // 8 - 3), np.uint8)], 1).tobytes().ljust(stride, b"\0") for r in pixels[::-1])
    head = b"BM" + (54 + len(table) + len(data)).to_bytes(4, "little") + bytes(4) + (54 + len(table)).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + width.to_bytes(4, "little") + height.to_bytes(4, "little") + b"\1\0" + bits.to_bytes(2, "little") + bytes(24)
    return head + info + table + data


def test_decoders():
    r = np.random.default_rng(1)
    colour, flat = r.integers(0, 256, (5, 7, 3), dtype=np.uint8), r.integers(0, 256, (5, 7), dtype=np.uint8)
    assert (media.decode(media.encode_ppm(colour)) == colour).all() and (media.decode(media.encode_ppm(flat)) == flat).all()
    text = b"P3 # a comment\n7 5\n255\n" + b" ".join(b"%d" % x for x in colour.reshape(-1))
    assert (media.decode(text) == colour).all()
    assert (media.decode(b"P2\n7 5\n255\n" + b" ".join(b"%d" % x for x in flat.reshape(-1))) == flat).all()
    bits = (flat & 1) * np.uint8(255)
    assert (media.decode(b"P1\n7 5\n" + b" ".join(b"%d" % (x == 0) for x in bits.reshape(-1))) == bits).all()
    assert (media.decode(b"P4\n7 5\n" + np.packbits(bits == 0, axis=1).tobytes()) == bits).all()
    # any largest value fills the range of its type
    assert media.decode(b"P2\n3 1\n15\n0 5 15").tolist() == [[0, 85, 255]]
    assert media.decode(b"P5\n2 1\n1023\n" + b"\x03\xff\0\0").tolist() == [[65535, 0]]
    deep = r.integers(0, 65536, (3, 4), dtype=np.uint16)
    assert (media.decode(b"P5\n4 3\n65535\n" + deep.astype(">u2").tobytes()) == deep).all()
    for depth in (24, 32):
        assert (media.decode(bmp(colour, depth)) == colour).all()
    grey = np.repeat(flat[:, :, None], 3, 2)
    assert (media.decode(bmp(grey, 8)) == grey).all()
    for bad in (b"", b"P9", b"P6\n2 2\n255\n\0", b"BM" + bytes(10), b"P2\n1 1\n255\n" + b"9" * 30, b"P2\n1 1\n255\n256", b"P5\n" + b"9" * 40 + b" 1\n255\n", b"P5\n1 1\n0\n\0", b"P2\n1 1\n" + b"9" * 5000):
        with pytest.raises(media.BadImage):
            media.decode(bad)


def test_bit_fields():
    """Masks say where a colour stands."""
    head = lambda bits, packed, masks, data: b"BM" + bytes(8) + (54 + len(masks)).to_bytes(4, "little") + struct.pack("<IiiHHI", 40, 2, 1, 1, bits, packed) + bytes(20) + masks + data
    masks = struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)
    assert media.decode(head(32, 3, masks, bytes([1, 2, 3, 0, 4, 5, 6, 0]))).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    assert media.decode(head(16, 3, struct.pack("<III", 0xF800, 0x7E0, 0x1F), struct.pack("<HH", 0xF800, 0x07E0))).tolist() == [[[255, 0, 0], [0, 255, 0]]]
    assert media.decode(head(16, 0, b"", struct.pack("<HH", 0x001F, 0x7FFF))).tolist() == [[[0, 0, 255], [255, 255, 255]]]


def test_difference_hash_by_hand():
    """Each bit says whether one of 8 x 9 blocks is brighter than its right neighbour."""
    x = np.random.default_rng(3).integers(0, 256, (16, 27)).astype(np.uint8)
    blocks = [[x[2 * i : 2 * i + 2, 3 * j : 3 * j + 3].mean() for j in range(9)] for i in range(8)]
    want = int("".join("1" if a > b else "0" for row in blocks for a, b in zip(row[:-1], row[1:], strict=True)), 2)
    assert media.difference_hash(x) == want


def test_area_resize():
    x = np.arange(24.0).reshape(4, 6)
    assert np.allclose(media.area_resize(x, 2, 3), x.reshape(2, 2, 3, 2).mean((1, 3)))
    assert np.allclose(media.area_resize(x, 4, 6), x) and np.allclose(media.area_resize(np.full((1, 5), 3.0), 8, 9), 3)
    assert np.isclose(media.area_resize(x, 3, 5).mean(), x.mean())


def test_image_tiles(spark):
    image = media.encode_ppm(np.random.default_rng(2).integers(0, 256, (9, 9, 3), dtype=np.uint8))
    table = spark.createDataFrame([(1, image, "x", 0), (2, b"junk", "x", 0), (3, None, "x", 0), (4, b"P2\n1 1\n255\n" + b"9" * 30, "x", 0)], "n int, image binary, _hash string, _row int")
    got = media.image_tiles(table).orderBy("n").collect()
    assert len(got[0]) == 8 and got[3]._error and not got[3]._tile
    assert np.load(io.BytesIO(bytes(got[0]._tile))).shape == (16, 16, 3) and len(got[0]._hash) == 16
    assert got[1]._error and got[1]._tile is None and got[2]._error is None and got[2]._tile is None


# --- 7 ---


def plain_removal(texts, window):
    seen = Counter(b[s : s + window] for b in texts for s in range(len(b) - window + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, sha(kept)))
    return out


def test_suffix_dedup(spark, empty):
    r = random.Random(8)
    shared = [words(900 + k, 60) for k in range(4)]
    given = rows()[:75] + rows()[75:82] + [(None, None, None, None, None)]
    for i in range(60):  # passages at odd places, cut and overlapping; and texts that repeat themselves
        part = shared[i % 4].encode()
        a = r.randrange(0, len(part) - 220)
        given.append((200 + i, words(i, 40) + part[a : a + r.randrange(150, 320)].decode() + words(i + 70, r.randrange(1, 30)), "en", "s", 0))
    given += [(300, "De " * 300, "de", "s", 0), (301, "x" * 199, "de", "s", 0), (302, "x" * 200, "de", "s", 0), (303, "ab" * 150 + "c", "de", "s", 0), (304, "é" * 260, "fr", "s", 0)]
    docs = spark.createDataFrame(given, SCHEMA).withColumn("k1", pytest.importorskip("pyspark.sql.functions").lit(1)).repartition(4)
    want = Counter((i, *x) for (i, *_), x in zip(given, plain_removal([(t or "").encode() for _, t, *_ in given], 200), strict=True))
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got)
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    # the way of anchors with very many kinds of runs gives the same
    rows_ = docs.selectExpr("xxhash64(doc_id, text) AS uid", "coalesce(text, '') AS text").dropDuplicates(["uid"])
    none = rows_.select("uid").filter("false")
    covers = lambda most: {(x.uid, s) for x in suffix_dedup.repeated_spans(rows_, none, most=most).collect() for s in range(x.start, x.start + x.n)}
    assert covers(1) == covers(50_000)


def test_suffix_dedup_of_repeated_rows(spark):
    """Ten thousand equal rows cost a span each; a text that quotes them loses the quotation."""
    text = words(77, 80)
    given = [(i, text) for i in range(10_000)] + [(20_000, "before " + text[40:300] + " after")]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(6)
    rows_ = docs.selectExpr("monotonically_increasing_id() AS uid", "xxhash64(text) AS k1", "xxhash64(1, text) AS k2", "octet_length(text) AS bytes", "text")
    from spoofscan.llm.common import materialise

    rows_ = materialise(rows_, "test-rows")
    equal = suffix_dedup.equal_texts(rows_.drop("text"), 200)
    assert equal.count() == 10_000
    assert suffix_dedup.repeated_spans(rows_, equal.filter("uid <> first").select("uid")).count() < 10
    got = {(r.n_removed, r.n_spans): n for r, n in Counter(suffix_dedup.suffix_dedup(docs, with_text=False).drop("doc_id").collect()).items()}
    assert got == {(len(text), 1): 10_000, (260, 1): 1}


# --- 9 ---


def test_mixing_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(mixing.SQL).fetchall()
    names = [x[0] for x in con.description] if con.description else ["doc_id", "size", "source_size", "target", "taken"]
    got = queries.QUERIES["op9_mixing"](spark, DATA).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_mixing(docs, empty):
    got = mixing.fair_mix(docs).toPandas()
    assert len(got) == len(rows()) and (got["taken"] <= 3 * got["size"]).all() and (got["target"] <= 3 * got["source_size"]).all()
    assert got["taken"].sum() <= got["size"].sum()
    targets = mixing.source_targets(docs.selectExpr("source", "size(filter(split(coalesce(text, ''), '[ \\t\\n]+'), x -> x <> '')) AS size")).toPandas()
    assert targets.sort_values("rank")["source"].tolist() == ["s0", "s1", "s2", "s3", None]
    assert np.isclose(targets["target"].sum(), targets["source_size"].sum())
    again = mixing.fair_mix(docs.repartition(3)).toPandas()
    assert Counter(map(tuple, got.astype(str).values)) == Counter(map(tuple, again.astype(str).values))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == got["copies"].sum()
    assert mixing.fair_mix(empty).count() == 0


# --- 10 ---


def plain_line_removal(given, least):
    """Of [(order, lines)], the removed line numbers: all in a run of `least` words or more that stands earlier too."""
    gone = [set() for _ in given]
    runs = {}
    for d, lines in enumerate(given):
        for s in range(len(lines)):
            n = 0
            for e in range(s, len(lines)):
                n += len(lines[e].split())
                if n >= least:
                    run = tuple(lines[s : e + 1])
                    if run in runs and runs[run] < (d, s):
                        gone[d] |= set(range(s, e + 1))
                    else:
                        runs.setdefault(run, (d, s))
    return gone


def test_line_dedup(spark, docs, empty):
    r = random.Random(4)
    pool = [" ".join(f"l{k}w{j}" for j in range(r.choice([0, 1, 3, 6, 12, 25]))) for k in range(14)]
    given = [[r.choice(pool) if r.random() < 0.7 else f"own {i} {j}" for j in range(r.randrange(1, 14))] for i in range(80)]
    given += [given[3], given[3], ["x y z"] * 9, [""] * 30]
    table = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(given)], "doc_id long, text string").repartition(5)
    want = plain_line_removal(given, 20)
    for x in line_dedup.line_dedup(table).collect():
        lines = given[x.doc_id]
        kept = [y for k, y in enumerate(lines) if k not in want[x.doc_id]]
        assert (x.n_lines, x.n_removed, x.text) == (len(lines), len(want[x.doc_id]), "\n".join(kept)), x
    assert line_dedup.line_dedup(empty).count() == 0
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == len(rows())
