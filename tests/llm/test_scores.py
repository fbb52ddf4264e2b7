"""Scores worked out again from their definitions: language by plain compression, quality by a plain chain, ownership by counting."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from stayline.llm import language, quality, secrets
from stayline.llm.batches import joined
from stayline.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 == 1


# ---- language: op9


def plain_dictionaries(rows):
    """The first 32 KB of the beginnings of 128 documents per language, in the order of the hashes of their ids."""
    out = {}
    for lang in sorted({r.lang for r in rows if r.lang is not None}):
        own = [r for r in rows if r.lang == lang and not held_out(r.doc_id) and any(c.isalpha() for c in r.text or "")]
        own.sort(key=lambda r: (hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.text[: 4 * language.SAMPLE_CHARS]))
        heads = [re.sub(r"[\W\d_]+", " ", r.text[: 4 * language.SAMPLE_CHARS].lower()).strip()[: language.SAMPLE_CHARS] for r in own[: language.SAMPLE_DOCS]]
        if own:
            out[lang] = " ".join(dict.fromkeys(h for h in heads if h)).encode()[: language.DICTIONARY_BYTES].ljust(8, b" ")
    return out


def test_language_from_scratch(spark, data, tables):
    rows = tables("documents").collect()
    how = zstandard.ZstdCompressionParameters(
        window_log=18, chain_log=15, hash_log=15, search_log=3, min_match=4, target_length=8, strategy=zstandard.STRATEGY_LAZY,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    machines = {
        lang: zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        for lang, d in plain_dictionaries(rows).items()
    }
    found = {r.doc_id: r for r in QUERIES["op9_language"](spark, data).collect()}
    assert len(found) == len(rows)
    for r in rows:
        got, text = found[r.doc_id], re.sub(r"[\W\d_]+", " ", (r.text or "").lower()).strip().encode()
        assert got.held_out == held_out(r.doc_id)
        if not any(c.isalpha() for c in text.decode()):
            assert (got.lang_pred, got.score, got.rejected) == ("und", 0.0, True)
            continue
        n = -(-len(text) // language.BLOCK_BYTES)
        size = -(-len(text) // n)
        parts = [text[i : i + size] + language._PADDING for i in range(0, len(text), size)]
        sizes = {lang: sum(len(m.compress(p)) for p in parts) for lang, m in machines.items()}
        best, second = sorted(sizes.values())[:2]
        assert got.lang_pred == min(lang for lang, s in sizes.items() if s == best)
        assert got.margin == pytest.approx((second - best) / second) and got.rejected == (got.margin < language.MIN_MARGIN)
        assert got.score == pytest.approx(1 / sum(math.exp(-language.SHARPNESS * (s - best) / best) for s in sizes.values()))


# ---- quality: op7


def plain_line(line, earlier):
    """A line's own features, character by character. ``earlier`` are the words of the lines before."""
    raw = line.encode()
    kinds = Counter()
    for b in raw:
        c = chr(b)
        if b >= 0x80:
            kinds["beyond"] += 1
        elif c.islower():
            kinds["lower"] += 1
        elif c.isupper():
            kinds["upper"] += 1
        elif c.isdigit():
            kinds["digit"] += 1
        elif c in " \t":
            kinds["blank"] += 1
        elif c in ".,;:?'\"":
            kinds["mark"] += 1
        elif c in "!|":
            kinds["loud"] += 1
        elif c in "#$%&*@^~_=+<>\\{}[]/":
            kinds["odd"] += 1
    names = ("lower", "upper", "digit", "beyond", "blank", "mark", "loud", "odd")
    share = [kinds[k] / max(len(raw), 1) for k in names]
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line))
    letters = kinds["lower"] + kinds["upper"] + kinds["beyond"]
    n = max(len(words), 1)
    return share + [math.sqrt(share[i]) for i in (1, 6, 7)] + [
        math.log1p(len(raw)) / 5, letters / n / 10, (len(words) - len(set(words))) / n, float(words in earlier), float(not raw)
    ]


def plain_score(text, field):
    lines, own, seen = (text or "").split("\n"), [], []
    for line in lines:
        own.append(plain_line(line, seen))
        seen.append(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    nothing = [0.0] * len(own[0])
    rows = [
        own[i] + (own[i - 1] if i else nothing) + (own[i + 1] if i + 1 < len(own) else nothing) + [1.0] for i in range(len(own))
    ]
    scores = ((np.array(rows) - field.centre) / field.spread) @ field.weights
    # Logarithms of the sums over all labellings that end, or begin, with a line's label.
    ahead, back = np.zeros((len(rows), 2)), np.zeros((len(rows), 2))
    for i in range(len(rows)):
        for y in (0, 1):
            before = np.logaddexp.reduce(ahead[i - 1] + field.ties[:, y]) if i else 0.0
            ahead[i, y] = before + scores[i] * y
    for i in reversed(range(len(rows) - 1)):
        for y in (0, 1):
            back[i, y] = np.logaddexp.reduce(field.ties[y] + back[i + 1] + scores[i + 1] * np.array([0, 1]))
    both = ahead + back
    good = 1 / (1 + np.exp(both[:, 0] - both[:, 1]))
    weight = [max(len(line.encode()), 1) for line in lines]
    mean = min(max(float(np.dot(good, weight)) / sum(weight), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(field.slope * math.log(mean / (1 - mean)) + field.shift)))


def test_quality_from_scratch(tables):
    docs = tables("documents")
    field = quality.learn(docs, tables("labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score(docs.select("doc_id", "text"), field).collect():
        expected = plain_score(texts[r.doc_id], field)
        assert r.score == pytest.approx(expected, abs=2e-4) and (r.predicted == int(expected >= 0.5) or abs(expected - 0.5) < 2e-4)


def test_the_fit_climbs(tables):
    """The fitted weights are better than none, and small steps in any direction hardly improve them."""
    labels = {r.doc_id: r.quality for r in tables("labels").collect() if r.quality is not None and not held_out(r.doc_id)}
    rows = [(r.text, labels[r.doc_id]) for r in tables("documents").collect() if r.doc_id in labels]
    features, lengths, first = quality.line_features(*joined(pa.array([t for t, _ in rows])))
    y = np.array([q for _, q in rows])
    field = quality.fit(features, lengths, first, y)
    p = field.scores(features, lengths, first)

    def loss(p):
        return -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))

    assert loss(p) < 0.5 * loss(np.full(len(y), y.mean()))
    for slope, shift in ((0.9, 0), (1.1, 0), (1, 0.2), (1, -0.2)):
        other = quality.Field(field.centre, field.spread, field.weights, field.ties, field.slope * slope, field.shift + shift)
        assert loss(other.scores(features, lengths, first)) > loss(p) - 0.01


# ---- secrets: op3


def plain_values(text):
    """(start, kind, end, value) of base spans and of the long runs apart from them, in characters."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    base = [(m.start(), 0, m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    more = [
        (m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[0-9A-Za-z_-]+", text)
        if len(m[0]) >= secrets.LEAST_OWNED and all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))
        and not any(s < m.end() and m.start() < e for s, _, e, _ in base)
    ]
    return sorted(base + more)


def plain_live(value):
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return bits >= secrets.LEAST_ENTROPY and not secrets.PLACEHOLDERS.search(value.encode())


def check_ownership(docs):
    rows = [(r.doc_id, r.source, plain_values(r.text or "")) for r in docs.collect()]
    repos, owners = defaultdict(set), defaultdict(set)
    for doc_id, source, spans in rows:
        for *_, value in spans:
            repos[value].add((doc_id, source))
            owners[value].add(source)
    expected = []
    for doc_id, _, spans in rows:
        live = [plain_live(v) and not (len(owners[v]) > secrets.MOST_OWNERS and len(repos[v]) > secrets.MOST_REPOS) for *_, v in spans]
        kept = [(s, ok) for s, ok in zip(spans, live) if s[1] < 3 or ok]
        text = ",".join(f"{('assign', 'access', 'hex', 'owned')[k]}:{a}:{b}" for (a, k, b, _), _ in kept)
        expected.append((doc_id, text, sum(s[1] == 3 for s, _ in kept), sum(ok for _, ok in kept), sum(not ok for _, ok in kept)))
    found = [(r.doc_id, r.spans, r.n_owned, r.n_live, r.n_example) for r in secrets.secret_spans(docs).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    return found


def test_ownership_over_all_documents(tables):
    found = check_ownership(tables("documents"))
    assert len(found) == tables("documents").count()


def test_ownership_of_made_documents(spark):
    values = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    mixed = [v[:12].upper() + v[12:26] for v in values]
    rows = []
    for i in range(300):
        rows.append((i, f"é {mixed[i % 40 if i < 200 else 0]} token = {values[i % 7]} x{mixed[i % 3]}-{i % 5}", f"o{i % (1 + i % 40 // 10)}"))
    check_ownership(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))


def test_overlaps_are_found_in_one_pass():
    rng = np.random.default_rng(3)
    for _ in range(50):
        base = sorted((int(a), int(rng.integers(3)), int(a + rng.integers(1, 40)), b"") for a in rng.integers(0, 500, 20))
        runs = [(a, a + int(rng.integers(1, 15))) for a in range(0, 500, 16)]
        assert secrets.apart(runs, base) == [r for r in runs if not any(s < r[1] and r[0] < e for s, _, e, _ in base)]
    assert secrets.apart([], [(1, 0, 2, b"")]) == [] and secrets.apart([(1, 2)], []) == [(1, 2)]


def test_a_key_dump_takes_time_in_proportion():
    def seconds(n):
        base = [(i * 100, 0, i * 100 + 40, b"") for i in range(n)]
        runs = [(i * 100 + 50, i * 100 + 90) for i in range(n)]
        start = time.perf_counter()
        assert len(secrets.apart(runs, base)) == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(200_000) < 5  # 20 MB of keys; every run against every span would be 4e10 comparisons
