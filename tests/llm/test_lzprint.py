import hashlib

import numpy as np

from flockpoint.llm.lzprint import _parse, both_fingerprints, edited, fingerprint, likeness, phrase_fingerprints


def phrases(data):
    """The parse with a set of phrases."""
    known, out, phrase = set(), [], b""
    for c in data:
        phrase += bytes([c])
        if phrase not in known:
            known.add(phrase)
            out.append(phrase)
            phrase = b""
    return out


def test_parse():
    for data in (b"", b"a", b"aaaaaaa", b"abracadabra abracadabra", bytes(range(256)) * 3):
        ends = []
        _parse(data, 0, {}, ends, 0)
        assert [data[a:b] for a, b in zip([0, *ends], ends, strict=False)] == phrases(data)


def test_front_is_shared():
    a, b = "the quick brown fox é jumps over the lazy dog" * 5, "some other text entirely " * 9
    own, other, changed = both_fingerprints(a, b, 64)
    assert own == fingerprint(a, 64) and other == fingerprint(changed, 64) and changed == edited(a, b)


def test_likeness_follows_the_phrase_sets():
    rng = np.random.default_rng(0)
    words = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(3000)]
    a = " ".join(words[:1500])
    assert likeness(fingerprint(a, 128), fingerprint(a, 128)) == 1 and likeness(b"", b"") == 1 and likeness(b"", fingerprint("a", 128)) == 0
    for keep in (1400, 700, 0):
        b = " ".join(words[:keep] + words[1500 : 3000 - keep])
        pa, pb = set(phrases(a.encode())), set(phrases(b.encode()))
        assert abs(likeness(fingerprint(a, 512), fingerprint(b, 512)) - len(pa & pb) / len(pa | pb)) < 0.09


def check(df, out):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["text"] or "") for r in df.collect())
    texts = [t for _, t in rows]
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r) for r in out)
    assert len(got) == len(rows)
    ids = [k for k, _ in rows]
    single = [k for k in ids if ids.count(k) == 1]
    by = {k: r for k, r in got}
    for i, (k, text) in enumerate(rows):
        if k in single and ids[(i + 1) % len(ids)] in single:
            changed = edited(text, texts[(i + 1) % len(texts)])
            r = by[k]
            assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
            assert r["fingerprint"] == fingerprint(text, 128).hex() and r["edited_fingerprint"] == fingerprint(changed, 128).hex()
            assert r["near_next"] == likeness(fingerprint(text, 128), fingerprint(texts[(i + 1) % len(texts)], 128))


def test_successors_over_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 97, f"text {i * 7 % 97} " * (i % 5 + 1)) for i in range(97)], "doc_id long, text string")
    for part in (8 << 20, 200):
        check(df, phrase_fingerprints(df, part_bytes=part).collect())
    one = df.filter("doc_id = 3")
    assert phrase_fingerprints(one).first()["near_next"] == 1


def test_edges(spark, edge, empty):
    check(edge, phrase_fingerprints(edge).collect())
    assert phrase_fingerprints(empty).count() == 0
