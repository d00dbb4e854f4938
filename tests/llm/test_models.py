"""Language ID, toxicity and GIF media: held-out accuracy, exact round trips, edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark.llm import gifmedia, langid, queries, toxicity

EDGES = [(-1, None), (-2, ""), (-3, "123 !?"), (-3, "123 !?"), (None, "x")]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def with_edges(spark, docs):
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(EDGES, "doc_id long, text string"))


# --- language -----------------------------------------------------------------------


def test_held_out_accuracy(spark, docs, sf_dir):
    got = queries.op8_language(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    for r in got.select("doc_id", "held_out").collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_edges_are_undetermined(spark, docs):
    prototypes = langid.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(EDGES, "doc_id long, text string"), prototypes).collect()}
    assert got[-1] == got[-2] == got[-3] == ("und", 0.0) and got[None][0] in prototypes


def test_no_labels_no_prototypes(spark):
    none = spark.createDataFrame([("text", None), ("", "en")], "text string, lang string")
    assert langid.learn(none) == {}
    got = langid.predict(spark.createDataFrame([(1, "words")], "doc_id long, text string"), {}).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
    only = langid.predict(spark.createDataFrame([(1, "words")], "doc_id long, text string"), {"en": np.ones(langid.DIMENSIONS)}).first()
    assert only["lang_pred"] == "en"


def test_binding_depends_on_places_and_letters():
    gram = lambda s: sum(ord(c) << (21 * i) for i, c in enumerate(s))
    a, b = langid.bound(gram("abc")).astype(int), langid.bound(gram("cba")).astype(int)
    assert set(np.unique(a)) == {-1, 1} and abs(a @ b) < 200
    found, counts = langid.grams("ab ab")
    assert counts.sum() == 5  # " ab", "ab ", "b a", " ab", "ab "


def test_full_binder_changes_nothing(monkeypatch):
    texts = ["the quick brown fox", "jumps over", "the lazy dog"]
    want = [langid.Binder().bundle(*langid.grams(t)) for t in texts]
    monkeypatch.setattr(langid, "BOUND_KEPT", 12)
    own = langid.Binder()
    for t, w in zip(texts, want):
        assert np.allclose(own.bundle(*langid.grams(t)), w)


def test_recognised_keeps_rows_as_they_are(spark, docs):
    more = docs.unionByName(spark.createDataFrame([(10**7, "123", "en", "s", 3), (10**7 + 1, None, None, None, None)], docs.schema))
    kept = langid.recognised(more)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in more.select("doc_id").subtract(kept.select("doc_id")).collect()} >= {10**7, 10**7 + 1}
    assert kept.count() >= 0.99 * docs.count()


def test_prototypes_against_a_plain_version(spark, docs):
    """Prototypes and decisions by loops over letters: permuted vectors multiplied, n-grams added, texts added."""
    rows = [(r["text"], r["lang"]) for r in docs.where("n_chars < 300 AND lang IS NOT NULL").limit(30).collect()]
    got = langid.learn(spark.createDataFrame(rows, "text string, lang string"))

    def plain(text):
        spaced = "".join(c if c.isalpha() else " " for c in text.lower())
        spaced = " " + " ".join(spaced.split()) + " "
        total = np.zeros(langid.DIMENSIONS)
        for i in range(len(spaced) - 2):
            gram = np.ones(langid.DIMENSIONS)
            for place, c in enumerate(spaced[i : i + 3]):
                gram *= np.roll(langid.letter_vector(ord(c)).astype(float), place)
            total += gram
        return total

    want: dict = {}
    for text, lang in rows:
        vector = plain(text)
        want[lang] = want.get(lang, 0) + vector / np.linalg.norm(vector)
    assert got.keys() == want.keys()
    for lang, total in want.items():
        assert np.allclose(got[lang], total / np.linalg.norm(total), atol=2e-3)
    matrix = np.array([want[k] / np.linalg.norm(want[k]) for k in sorted(want)])
    shared = matrix.mean(axis=0)
    profiles = langid.Profiles(got)
    for text, _ in rows:
        vector = plain(text)
        rest = vector - shared * (vector @ shared) / (shared @ shared)
        cosines = [(m - shared) @ rest / np.linalg.norm(m - shared) / np.linalg.norm(rest) for m in matrix]
        name, score = profiles.nearest(text)
        assert abs(score - (1 + max(cosines)) / 2) < 2e-3
        assert name == sorted(want)[int(np.argmax(cosines))] or sorted(cosines)[-1] - sorted(cosines)[-2] < 4e-3


def test_unknown_languages_and_noise_go(spark, docs):
    rng = random.Random(6)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(20)]
    foreign = ["Это русский текст о погоде и о том, как проходит обычный день в городе", "これは日本語の文章で、天気と日常生活について長く書かれています。今日は朝から雨が降っています。" * 2]
    short = ["ok", "Osrañ."]
    labelled = docs.where("lang IS NOT NULL")
    more = [(10**7 + i, t) for i, t in enumerate(noise + foreign + short)]
    both = labelled.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")))
    kept = {r["doc_id"] for r in langid.recognised(both).select("doc_id").collect()}
    assert not kept & {10**7 + i for i in range(len(noise + foreign))}
    assert {10**7 + len(noise + foreign) + i for i in range(len(short))} <= kept
    assert {r["doc_id"] for r in labelled.select("doc_id").collect()} <= kept


def test_nothing_learnt_keeps_all(spark):
    rows = spark.createDataFrame([(1, "words", None), (2, None, None), (3, "123", None)], "doc_id long, text string, lang string")
    assert langid.recognised(rows).count() == 3


# --- toxicity -----------------------------------------------------------------------


def test_ordinal_model_separates_grades(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        grade = rng.choice([0, 0, 0, 1, 2])
        words = [f"w{rng.randrange(300)}" for _ in range(40)] + ["badword"] * (grade >= 1) + ["worseword"] * (grade >= 2)
        rng.shuffle(words)
        rows.append((i, " ".join(words), grade))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    model = toxicity.fit(df.where("doc_id < 600"), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    got = {r["doc_id"]: r for r in toxicity.grade_severity(df.where("doc_id >= 600"), model).collect()}
    means = [np.mean([got[i]["severity"] for i, _, g in rows if i >= 600 and g == k]) for k in range(3)]
    assert means[0] < means[1] < means[2]
    assert np.mean([got[i]["toxic"] == (g > 0) for i, _, g in rows if i >= 600]) > 0.98


def test_toxic_documents_are_found(spark, docs, sf_dir):
    """A few hundred labels teach the common words only; the recall is far higher with thousands (README)."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    got = queries.op5_toxicity(spark, big).join(labels.withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert np.mean([r["toxic"] for r in got if r["y"] == 1]) >= 0.6
    assert np.mean([r["toxic"] for r in got if r["y"] == 0]) <= 0.03


def test_all_toxic_texts_with_a_sign_are_found(spark, sf_dir):
    """18 of the 51 toxic labels of sf0.01 are on texts without any word that is typical of toxic ones."""
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where("toxic IS NOT NULL").select("doc_id", "text", "toxic").collect()
    n: dict = {}
    for r in rows:
        for w in toxicity.words_of(r["text"] or ""):
            n.setdefault(w, [0, 0])[r["toxic"]] += 1
    marks = {w for w, (clean, toxic) in n.items() if toxic >= 10 and not clean}
    signed = {r["doc_id"] for r in rows if r["toxic"] and toxicity.words_of(r["text"] or "") & marks}
    found = {r["doc_id"] for r in queries.op5_toxicity(spark, big).where("toxic").collect()}
    assert len(marks) == 10 and len(signed) == 33
    assert len(signed & found) >= 0.95 * len(signed)


def test_descent_against_plain_steps():
    """The same steps by loops over rows and words."""
    rng = np.random.default_rng(0)
    n, m, grades = 60, 7, 3
    rows = [np.flatnonzero(rng.random(m) < 0.4) for _ in range(n)]
    grade = np.array([min(2, int(0 in r) + int(1 in r)) for r in rows])
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    got = toxicity._descend(owner, np.concatenate(rows), np.arange(m), grade, grades, 25, 1e-4)
    share = [np.mean(grade == g) for g in range(grades)]
    weight = np.array([1 / share[g] for g in grade])
    weight /= weight.sum()
    t = np.array([np.log((1 - r) / r) for r in (np.mean(grade > k) for k in range(grades - 1))])
    w, gw, gt = np.zeros(m), np.full(m, 1e-8), np.full(grades - 1, 1e-8)
    for _ in range(25):
        dw, dt = 1e-4 * w, np.zeros(grades - 1)
        for i, words in enumerate(rows):
            for k in range(grades - 1):
                error = (1 / (1 + np.exp(-(w[words].sum() - t[k]))) - (grade[i] > k)) * weight[i]
                dw[words] += error
                dt[k] -= error
        gw, gt = gw + dw**2, gt + dt**2
        w -= 0.3 * dw / np.sqrt(gw)
        t = np.maximum.accumulate(t - 0.3 * dt / np.sqrt(gt))
    keep = np.abs(w) > 1e-3
    assert np.allclose(got.thresholds, t) and np.allclose(got.weights, w[keep]) and got.keys.tolist() == np.flatnonzero(keep).tolist()
    texts = [r.tolist() for r in rows]
    want = [sum(1 / (1 + np.exp(-(w[[x for x in r if keep[x]]].sum() - k))) for k in t) for r in texts]
    assert np.allclose(got.severities(texts), want)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, "bad words", "x")] * 3000 + [(2, "good words", "y"), (None, "bad", "z")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, 0, 0), (None, 1, 1), (3, None, 0)], "doc_id long, toxic int, quality int")
    assert sorted(map(tuple, toxicity.severity_labels(docs, labels).collect())) == [("bad words", 1), ("good words", 0)]


def test_toxicity_with_clashing_columns(spark):
    model = toxicity.fit(spark.createDataFrame([("bad thing", 1), ("good thing", 0)] * 60, "text string, grade int"), 2)
    rows = spark.createDataFrame([(1, "bad thing", 5, "t", 0.5), (1, "bad thing", 5, "t", 0.5), (2, "good thing", 6, "u", 0.1)], "doc_id long, text string, grade int, toxic string, severity double")
    got = toxicity.grade_severity(rows, model).collect()
    assert sorted((r["doc_id"], r["toxic"], r["grade"]) for r in got) == [(1, True, 1), (1, True, 1), (2, False, 0)]


def test_toxicity_edges(spark):
    none = toxicity.fit(spark.createDataFrame([], "text string, grade int"), 3)
    rows = toxicity.grade_severity(spark.createDataFrame(EDGES, "doc_id long, text string"), none).collect()
    assert len(rows) == len(EDGES) and all(r["severity"] == 0 and not r["toxic"] for r in rows)


# --- GIF ----------------------------------------------------------------------------


def lzw_encode(data: list[int], size: int, rng: random.Random) -> bytes:
    """A plain LZW writer that grows its table and clears it now and then."""
    clear = 1 << size
    table, out, acc, n = {}, bytearray(), 0, 0
    width, free = size + 1, clear + 2

    def put(code: int) -> None:
        nonlocal acc, n
        acc |= code << n
        n += width
        while n >= 8:
            out.append(acc & 255)
            acc >>= 8
            n -= 8

    put(clear)
    word: tuple = ()
    for c in data:
        if len(word) == 0 or word + (c,) in table:
            word += (c,)
            continue
        put(word[0] if len(word) == 1 else table[word])
        if free < 4096:
            table[word + (c,)] = free
            free += 1
            if free - 1 == 1 << width and width < 12:
                width += 1
        elif rng.random() < 0.5:
            put(clear)
            table, width, free = {}, size + 1, clear + 2
        word = (c,)
    if word:
        put(word[0] if len(word) == 1 else table[word])
        if free < 4096 and free == 1 << width and width < 12:
            width += 1
    put(clear + 1)
    if n:
        out.append(acc & 255)
    return bytes(out)


@pytest.mark.parametrize("size", [2, 3, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 300, 40_000])
def test_lzw_streams(size, n):
    rng = random.Random(size * 100 + n)
    for data in ([rng.randrange(1 << size) for _ in range(n)], [0] * n, [rng.randrange(2) for _ in range(n)]):
        assert gifmedia.lzw_read(lzw_encode(data, size, rng), size)[:n].tolist() == data


@pytest.mark.parametrize("n", [1, 249, 250, 251, 500, 576, 36_864])
def test_written_streams(n):
    data = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    assert (gifmedia.lzw_read(gifmedia.lzw_write(data), 8)[:n] == data).all()


def _gif(frames: list[tuple], palette: bytes, size=(4, 4)) -> bytes:
    """frames: (left, top, w, h, indices, disposal, transparent or None, interlaced, local palette or None)."""
    out = b"GIF89a" + bytes([size[0], 0, size[1], 0, 0xF1, 0, 0]) + palette
    for left, top, w, h, idx, disposal, clear, lace, own in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), 5, 0, clear or 0]) + b"\0"
        out += b"\x2c" + bytes([left, 0, top, 0, w, 0, h, 0, (0x40 if lace else 0) | (0x81 if own else 0)]) + (own or b"") + b"\x02"
        body = lzw_encode(idx, 2, random.Random(0))
        out += bytes([len(body)]) + body + b"\0"
    return out + b"\x3b"


RED, GREEN, BLUE, WHITE = (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255)
PALETTE = bytes(sum((RED, GREEN, BLUE, WHITE), ()))


def test_disposal_and_transparency():
    frames = [
        (0, 0, 4, 4, [0] * 16, 1, None, False, None),  # red, stays
        (1, 1, 2, 2, [1] * 4, 3, None, False, None),  # green, then undone
        (0, 0, 4, 1, [2, 3, 2, 3], 2, 3, False, None),  # blue, white is clear; then background
        (0, 3, 1, 1, [0], 0, None, False, bytes(BLUE + BLUE + BLUE + BLUE)),  # local palette
    ]
    shots = [(f["start_ms"], f["canvas"].copy()) for f in gifmedia.read_gif(_gif(frames, PALETTE))]
    assert [t for t, _ in shots] == [0, 50, 100, 150]
    assert tuple(shots[1][1][1, 1, :3]) == GREEN and tuple(shots[1][1][0, 0, :3]) == RED
    assert tuple(shots[2][1][1, 1, :3]) == RED  # undone
    assert tuple(shots[2][1][0, 0, :3]) == BLUE and tuple(shots[2][1][0, 1, :3]) == RED  # transparent keeps
    assert shots[3][1][0, 0, 3] == 0 and tuple(shots[3][1][3, 0, :3]) == BLUE  # cleared, local palette


def test_interlaced_rows():
    rows = [0, 1, 2, 3, 0, 1, 2, 3]
    stored = [rows[r] for r in gifmedia._row_order(8)]
    frames = [(0, 0, 4, 8, [c for c in stored for _ in range(4)], 0, None, True, None)]
    canvas = next(iter(gifmedia.read_gif(_gif(frames, PALETTE, (4, 8)))))["canvas"]
    assert [tuple(canvas[y, 0, :3]) for y in range(8)] == [(RED, GREEN, BLUE, WHITE)[i] for i in rows]


def test_media_query(spark, docs):
    got = gifmedia.report(gifmedia.from_media(gifmedia.to_media(with_edges(spark, docs)))).collect()
    texts = with_edges(spark, docs).collect()
    assert len(got) == len(texts)
    by: dict = {}
    for i, t in texts:
        by.setdefault(i, t or "")
    for r in got:
        raw = by[r["doc_id"]].encode()
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(want[-32:])
        assert r["media_bytes"] == len(gifmedia.write_gif(want))
        assert sum(map(int, r["feature"].split(","))) == len(want)
        assert r["media_sha256"] == hashlib.sha256(gifmedia.write_gif(want)).hexdigest()


def test_media_that_are_no_gif(spark):
    rows = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"PNG")), (3, 0, bytearray(b"GIF89a" + bytes(20)))], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in gifmedia.from_media(rows).select("doc_id", "payload", F.size("frames").alias("n")).collect()}
    assert got[1]["payload"] is None and got[2]["payload"] is None and got[3]["n"] == 0


def _coloured() -> bytes:
    frames = [(0, 0, 4, 4, [0] * 16, 1, None, False, None), (0, 0, 4, 2, [1] * 8, 1, None, False, None), (0, 2, 4, 2, [2] * 8, 1, None, False, None)]
    return _gif(frames, PALETTE)


def test_colours_and_composed_frames(spark):
    rows = spark.createDataFrame([(1, 16, bytearray(_coloured()), "x")], "doc_id long, n_bytes long, media binary, payload string")
    r = gifmedia.from_media(rows).first()
    assert r["complete"] and list(r["payload"]) == [0] * 16 + [1] * 8 + [2] * 8
    red, green, blue = (r["frames"][i]["colours"] for i in range(3))
    top = gifmedia.BINS - 1
    assert red[top] == 16 and green[gifmedia.BINS + top] == 8 and blue[2 * gifmedia.BINS + top] == 8
    assert r["frames"][0]["histogram"] == [2 * x for x in r["frames"][1]["histogram"]]  # alike in brightness
    shots = gifmedia.composed(rows).orderBy("frame").collect()
    assert [(s["frame"], s["start_ms"], s["width"], s["height"]) for s in shots] == [(0, 0, 4, 4), (1, 50, 4, 4), (2, 100, 4, 4)]
    last = np.frombuffer(shots[2]["rgba"], np.uint8).reshape(4, 4, 4)
    assert tuple(last[0, 0, :3]) == GREEN and tuple(last[3, 3, :3]) == BLUE


def test_broken_files_never_fail():
    """Every cut and many changed bytes: frames before the break, and no exception; a huge canvas gives none."""
    whole, coloured = gifmedia.write_gif(gifmedia.padded(b"some text " * 120)), _coloured()
    for data in (whole, coloured):
        n = len(gifmedia._decoded(data)["frames"])
        for cut in range(3, len(data)):
            got = gifmedia._decoded(data[:cut])
            assert not got["complete"] and len(got["frames"]) <= n
        for place in range(3, len(data), 1 if data is coloured else 7):
            for value in (0, 255, data[place] ^ 0x55):
                gifmedia._decoded(data[:place] + bytes([value]) + data[place + 1 :])
    huge = b"GIF89a" + b"\xff" * 4 + whole[10:]
    assert gifmedia._decoded(huge) == {"payload": b"", "frames": [], "histogram": [0] * gifmedia.BINS, "colours": [0] * 3 * gifmedia.BINS, "complete": False}


def test_written_streams_use_the_table():
    """Repeats take dictionary codes, so text gets smaller; streams past a full table read back too."""
    data = np.frombuffer(b"the same words again and again, " * 1152, np.uint8)
    assert len(gifmedia.lzw_write(data)) < len(data) / 5
    noise = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8)
    for x in (data, noise, np.zeros(0, np.uint8), np.full(50_000, 7, np.uint8)):
        assert gifmedia.lzw_read(gifmedia.lzw_write(x), 8).tolist() == x.tolist()


def test_media_and_language_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "text here", "a", "b", "c", "d")], "doc_id long, text string, media string, n_bytes string, lang_pred string, score string")
    assert gifmedia.report(gifmedia.from_media(gifmedia.to_media(rows))).first()["n_bytes"] == 9
    assert langid.predict(rows, {"en": np.ones(langid.DIMENSIONS)}).first()["lang_pred"] == "en"


@pytest.mark.parametrize("n,found", [(0, 0), (1, 0), (10, 0), (40, 1), (48, 1), (400, 1)])
def test_few_labels(spark, n, found):
    """One word parts the rows perfectly, one in four toxic: from a few dozen rows on it is learnt."""
    rows = [(i, f"{'vile' if i % 4 == 0 else 'kind'} text of number n{i}", int(i % 4 == 0)) for i in range(n)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.severity_labels(docs, labels), grades=4)
    new = spark.createDataFrame([(1, "a vile one"), (2, "a kind one"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["toxic"] for r in toxicity.grade_severity(new, model).collect()}
    assert got == {1: bool(found), 2: False, 3: False}


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_class(spark, toxic):
    docs = spark.createDataFrame([(i, f"some words w{i % 5}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic) for i in range(60)], "doc_id long, toxic int")
    rows = toxicity.grade_severity(docs, toxicity.fit(toxicity.severity_labels(docs, labels), grades=4)).collect()
    assert len(rows) == 60 and len({(r["severity"], r["toxic"]) for r in rows}) == 1
