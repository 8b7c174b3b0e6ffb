import hashlib
import random
import re

from talkgrain.llm import fingerprints, licenses, pii, secrets
from tests.llm import cases

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for _, s, k, e in spans).encode()).hexdigest()


def plain_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return [(o, s, k, e) for s, o, k, e in sorted(out)]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(d)) % 10 == 0


def plain_pii(t):
    digits = lambda s: sum(c.isdigit() for c in s)
    out = [(0, m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= digits(m[0]) <= 19 and luhn(m[0])]
    out += [(3, m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= digits(m[0]) <= 15]
    return sorted(out)


def junk(spark, parts, n, seed):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(1, 40))), None, f"s{r.randrange(9)}", None) for i in range(n)]
    return spark.createDataFrame(rows + cases.odd_rows()[:0], cases.SCHEMA), {i: t for i, t, *_ in rows}


PII = ["a@b.c", "@", ".", "d%", "-", "1", "22", "4111 1111 1111 1111", "255", "256", " ", "+1", " (", "987-654-3210", "é😀", "+49 30 1234567", "x", "0", "4012888888881881", ".com", "007", "+"]
SECRETS = ["token", "=", ":", " ", "'", '"', "abcdefgh", "Password", "api_key", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é😀", "secret", "apikey", "passwd", "/", ".", "ghp_" + "Ab1" * 12]


def test_personal_data_against_plain_patterns(spark):
    docs, texts = junk(spark, PII, 400, 1)
    for r in pii.summary(pii.scan(docs)).collect():
        spans = plain_pii(texts[r.doc_id])
        assert r.base_sha256 == digest(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in ("email", "ip", "card", "phone")]
        assert {f"{k}:{s}:{e}" for _, s, k, e in spans} <= set(r.spans.split(","))


def test_secrets_against_plain_patterns(spark):
    docs, texts = junk(spark, SECRETS, 400, 2)
    for r in secrets.summary(secrets.scan(docs)).collect():
        spans = plain_secrets(texts[r.doc_id])
        assert r.base_sha256 == digest(spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")]
        assert {f"{k}:{s}:{e}" for _, s, k, e in spans} <= set(r.spans.split(","))


def test_ownership_tells_examples_from_live_secrets(spark):
    rows = [(i, "use token=EXAMPLE12345678 here", "en", f"s{i}", 1) for i in range(6)] + [(9, "my password=own8live99 and token=EXAMPLE12345678", "en", "s1", 1)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    got = {r.doc_id: (r.n_live, r.n_copied) for r in secrets.summary(secrets.scan(docs)).collect()}
    assert got == {**{i: (0, 1) for i in range(6)}, 9: (1, 1)}
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()}[9] == "my [SECRET] and token=EXAMPLE12345678"
    assert secrets.redact(docs).count() == len(rows)


def _pem(seed, lines=4, end="-----END RSA PRIVATE KEY-----", sep="\n", head=""):
    r = random.Random(seed)
    body = sep.join("".join(r.choice("ABCXYZabcxyz0189+/") for _ in range(64)) for _ in range(lines)) + sep + "Qk9yPQ=="
    return f"-----BEGIN RSA PRIVATE KEY-----{sep}{head}{body}" + (f"{sep}{end}" if end else "")


def test_distinct_private_keys_stay_live_and_go_whole(spark):
    ways = [{}, {"end": ""}, {"sep": "\\n"}, {"head": "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D\n\n"}, {"sep": "\r\n"}, {"sep": " "}, {"lines": 3000}]
    rows = [(i, f"my é key\n{_pem(i, **way)}\nand more words", "en", f"s{i}", 1) for i, way in enumerate(ways)]
    copied = [(100 + i, f"sample {_pem(99, sep=sep)} here", "en", f"s{i}", 1) for i, sep in enumerate(["\n", "\r\n", " ", "\\n"])]
    docs = spark.createDataFrame(rows + copied, cases.SCHEMA)
    scanned = {r.doc_id: [(x.start, x.end) for x in r.all if x.kind == "pem"] for r in secrets.scan(docs).collect()}
    assert scanned == {**{i: [(9, 9 + len(_pem(i, **way)))] for i, way in enumerate(ways)}, **{r[0]: [] for r in copied}}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert clean == {**{i: "my é key\n[SECRET]\nand more words" for i in range(len(ways))}, **{r[0]: r[1] for r in copied}}


def test_private_key_header_without_a_key(spark):
    docs = spark.createDataFrame([(1, "a -----BEGIN PRIVATE KEY----- line starts it", "en", "s", 1)], cases.SCHEMA)
    assert secrets.redact(docs).first().text == "a [SECRET] line starts it"


def test_scans_of_odd_rows_and_nothing(spark):
    docs, n = cases.odd(spark), len(cases.odd_rows())
    for frame in (pii.summary(pii.scan(docs)), secrets.summary(secrets.scan(docs)), licenses.scan(docs), fingerprints.fingerprints(docs)):
        assert frame.count() == n
    e = cases.empty(spark)
    for frame in (pii.summary(pii.scan(e)), secrets.summary(secrets.scan(e)), licenses.scan(e), fingerprints.fingerprints(e)):
        assert frame.count() == 0


def test_reliable_labelers_weigh_more():
    counts = [(0, 1, 1, 1, 1, 90), (0, 0, 0, -1, 0, 80), (0, 1, 0, 1, 1, 9), (0, 0, 1, -1, 0, 8)]
    odds, post = pii.reliabilities(counts)
    assert post[0] > 0.9 and post[1] < 0.1 and odds[0, 2] > 0 > odds[0, 1]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_licenses_against_plain_search(spark):
    parts = ["The MIT License ", "cc-by ", "CC BY ", "apache\nlicense ", "gnu ", "general public ", "GNU General Public License ", "license", "é cc", " by ", "x "]
    docs, texts = junk(spark, parts, 200, 3)
    for r in licenses.scan(docs).collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", texts[r.doc_id].translate(LOWER))
        at = [(i, label) for p, label in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_whole_license_texts(spark):
    """A text with a word changed here and there, one that is cut short, and a scan against counting k-grams by hand."""
    from talkgrain.llm.license_texts import TEXTS

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.translate(LOWER))
    rows, want = [], {}
    for i, (text, label) in enumerate(TEXTS):
        w = split(text)
        changed = [x if j % 40 else "other" for j, x in enumerate(w)]
        for d, own in ((3 * i, text), (3 * i + 1, f"{cases.prose(i, 30)} {' '.join(changed)} {cases.prose(i + 99, 30)}"), (3 * i + 2, " ".join(w[: len(w) // 2]))):
            rows.append((d, own, None, None, None))
            grams = {tuple(split(own)[j : j + 4]) for j in range(len(split(own)))}
            want[d] = (label, sum(tuple(w[j : j + 4]) in grams for j in range(len(w) - 3)) / (len(w) - 3))
    for r in licenses.scan(spark.createDataFrame(rows, cases.SCHEMA)).collect():
        label, cover = want[r.doc_id]
        assert (label in r.labels.split(",")) == (cover >= licenses.TEXT_COVER), (r, cover)
        assert r.n_base or not r.labels or r.score >= min(cover, licenses.TEXT_COVER)


def test_many_matches_and_long_chains_in_one_text(spark):
    """Work that grows with a match's number or a label's depth would not end, or end the JVM."""
    texts = ["a@" + "b." * 200_000 + "c", "write to ab@c.de or é " * 50_000, "eyJ" * 50_000, "1." * 100_000, "token=abcdefgh12 " * 50_000]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(texts)], cases.SCHEMA)
    found = {r.doc_id: r for r in pii.summary(pii.scan(docs)).collect()}
    assert (found[0].n_email, found[1].n_email, found[3].n_ip) == (1, 50_000, 25_000)
    assert found[1].spans.endswith(f"email:{22 * 49_999 + 9}:{22 * 49_999 + 16}")
    assert {r.doc_id: r.n_assign for r in secrets.summary(secrets.scan(docs)).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 50_000}


def test_notices_may_have_words_inserted_but_not_another_version(spark):
    rows = [(1, "licensed under the gnu general public license version 3", None, None, None), (2, "permission is hereby granted free of any charge to any person obtaining a copy of this software", None, None, None)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    assert got[1] == "gpl,gpl-3.0"
    assert got[2] in ("", "mit-text")


def test_fingerprints_against_sets(spark):
    rows = [(i * 3, cases.prose(i, 150 + 20 * i) if i % 4 else cases.prose(1, 150 + 20 * i), None, None, None) for i in range(12)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, cases.SCHEMA)).collect()}
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    like = lambda a, b: len(a & b) / len(a | b)
    for i, (d, t, *_) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(sets(t), sets(edited))) < 0.2 and abs(r.near_next - like(sets(t), sets(after))) < 0.2


def test_fingerprints_are_the_least_shingle_hashes(spark):
    """The sketch, computed plainly from the hashes that Spark gives each shingle."""
    import base64

    from pyspark.sql import functions as F

    texts = [cases.prose(1, 400), cases.prose(2, 40), "One  two\tthree four FIVE", "a b", "", cases.prose(1, 400).upper()]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], cases.SCHEMA)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    for i, t in enumerate(texts):
        w = t.lower().split()
        shingles = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        rows = spark.createDataFrame([(list(s),) for s in set(shingles)] or [(w,)], "w array<string>")
        five = [F.col("w")[j] for j in range(5)] if shingles else [F.col("w")]
        least = sorted({(r.s % 2**64) >> 16 for r in rows.select(F.xxhash64(*five).alias("s")).collect()})
        raw = b"".join(h.to_bytes(6, "big") for h in least[: fingerprints.K]) if w else b""
        assert base64.b64decode(got[i].fingerprint) == raw
    assert got[0].fingerprint == got[5].fingerprint


def test_sketches_merge_and_estimate(spark):
    from pyspark.sql import functions as F

    a, b = cases.prose(1, 900).split(), cases.prose(2, 900).split()
    df = spark.createDataFrame([(a, b, a + b)], "a array<string>, b array<string>, u array<string>")
    s = df.select(*[fingerprints.sketch(F.col(c)).alias(c) for c in "abu"])
    r = s.select(fingerprints.distinct(F.col("u")).alias("n"), fingerprints.containment(F.col("a"), F.col("u")).alias("c"), fingerprints.resemblance(fingerprints.merge(F.col("a"), F.col("b")), F.col("u")).alias("m")).first()
    assert abs(r.n - 1796) < 600 and r.c > 0.6 and r.m > 0.9
    parts = s.select(F.lit(1).alias("key"), F.explode(F.array("a", "b")).alias("sk"))
    assert fingerprints.merged_by(parts, "key", "sk").first().sk == s.select(fingerprints.merge(F.col("a"), F.col("b")).alias("m")).first().m


def test_every_row_meets_its_next_one_across_ranges(spark, monkeypatch):
    """Many small ranges, null and repeated ids: each text gets the start of the next one, the last that of the first."""
    monkeypatch.setattr(fingerprints, "PER_RANGE", 3)
    monkeypatch.setattr(fingerprints, "PER_TASK", 7)
    ids = [None] * 5 + [7] * 9 + list(range(100, 140, 3)) + [2**40]
    rows = [(d, f"{i % 4} " * (i % 6) + "é" * (i % 5), "en", "web", 0) for i, d in enumerate(ids)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for r, after in zip(order, order[1:] + order[:1], strict=True):
        half = len(r[1]) // 2
        edited = r[1][: len(r[1]) - half] + after[1][:half]
        want.append((r[0], len(r[1]), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprints.fingerprints(spark.createDataFrame(rows[::-1], cases.SCHEMA).repartition(5)).collect()
    assert sorted(want, key=str) == sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str)
