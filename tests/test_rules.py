"""Golden expectations on small inline mails."""

import ipaddress

import pytest
from pyspark.sql import functions as F

from lurelens.functions import domains as DF
from lurelens.functions import links as L
from lurelens.functions.risk import ladder
from lurelens.operators import cleaning as C
from lurelens.operators import domains as D
from lurelens.operators import features as E
from lurelens.operators import links as U
from lurelens.plans import scoring

SCHEMA = "id int, subject string, body string, from_email string, reply_to string, urls array<string>"
CASES = [
    (1, "", "", "", "", ["https://bit.ly/abc123", "https://tinyurl.com/xyz"]),
    (2, "", "", "", "", ["https://phishing.xyz", "https://suspicious.top"]),
    (3, "", "", "a@paypal.com", "b@phishing-site.com", []),
    (4, "", "", "User@Company.COM", "user@company.com", []),
    (5, "", "", "user@company.com", "", []),
    (6, "", "", "", "", ["https://192.168.1.1/admin"]),
    (7, "", "", "", "", ["https://example.com/path%2Fadmin%3Fpass%3D123"]),
    (8, "", "", "", "", ["https://google.com", "https://github.com/project"]),
    (9, "", "", "", "", []),
    (10, "x", "y", "z", "", ["ht!tp://invalid", "ftp://legacy.proto", "not-a-url-at-all", "", None]),
    (11, None, None, None, None, [f"https://site{i}.com" for i in range(5)]),
]


def test_operational_goldens(spark):
    rows = {r.id: r for r in E.operational_features(spark.createDataFrame(CASES, SCHEMA)).collect()}
    assert len(rows) == len(CASES)
    assert rows[1].shortened_url_detected == 1
    assert rows[2].suspicious_tld_detected == 1
    assert rows[3].domain_mismatch == 1
    assert rows[4].domain_mismatch == 0 and rows[5].domain_mismatch == 0
    assert rows[6].encoded_url_detected == 1 and rows[7].encoded_url_detected == 1
    r = rows[8]
    assert (r.shortened_url_detected, r.suspicious_tld_detected, r.encoded_url_detected, r.domain_mismatch) == (0, 0, 0, 0)
    assert rows[9].url_count == 0 and rows[9].urgency_score == 0
    assert rows[10].url_count == 5 and rows[11].url_count == 5


def test_every_mail_gets_one_bounded_verdict(spark):
    out = scoring.score_mails(spark.createDataFrame(CASES, SCHEMA)).collect()
    assert sorted(r.id for r in out) == [c[0] for c in CASES]
    for r in out:
        assert 0 <= r.probability <= 1 and 0 <= r.trust_score <= 1 and 1 <= len(r.reasoning) <= 5


def test_cleaning_sample(spark):
    text = "<html><body><p>Email: a@b.com | tel (555) 123-4567 &amp; more</p></body></html>\n\n--\nSent from my phone\nlost"
    got = spark.createDataFrame([(text,)], "t string").select(C.clean_body(F.col("t"))).first()[0]
    assert got == "email: email | telphone & more\n--"


def test_html_parser_agrees_on_simple_markup(spark):
    html = "<html><head><style>p{}</style><script>var x='<p>';</script></head><body><p>Hi &eacute; &amp; <b>you</b></p><!-- no --></body></html>"
    row = spark.createDataFrame([(html,)], "h string").select(C.parse_html(F.col("h")).alias("p"), C.strip_html(F.col("h")).alias("s")).first()
    assert row.p == "Hi é & you"
    assert row.s == "Hi &eacute; & you"


@pytest.mark.parametrize("domain,expected", [
    ("google.com", "exact"), ("mail.google.com", "subdomain"), ("x.mail.google.com", "subdomain"), ("evil.google.com", "unknown_subdomain"),
    ("irs.gov", "gov_pattern"), ("example.net", "none"), ("", "none"), ("retail.sbi.co.in", "subdomain")])
def test_trust_match(spark, domain, expected):
    row = spark.range(1).select(DF.trust_match(F.lit(domain)).alias("m")).first().m
    assert row.match_type == expected


def test_base_domain_variants(spark):
    rows = [("a.b.co.uk",), ("co.uk",), ("x.net.uk",), ("single",), ("mail.google.com",)]
    got = spark.createDataFrame(rows, "d string").select("d", DF.base_domain(F.col("d"), "analyzer").alias("a"), DF.base_domain(F.col("d")).alias("t")).collect()
    assert {r.d: (r.a, r.t) for r in got} == {
        "a.b.co.uk": ("b.co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.net.uk": ("net.uk", "x.net.uk"), "single": ("single", "single"),
        "mail.google.com": ("google.com", "google.com")}


def test_impersonation_and_lookalike(spark):
    rows = [("paypa1-secure.com",), ("paypal.com",), ("gma1l.com",)]
    df = spark.createDataFrame(rows, "domain string")
    hits = {(r.domain, r.brand) for r in D.impersonation_hits(df, "domain").collect()}
    assert ("paypa1-secure.com", "paypal") in hits and not [h for h in hits if h[0] == "paypal.com"]
    pairs = {(r.base, r.brand): r.ratio for r in D.lookalike_domains(df, "domain").collect()}
    assert round(pairs[("gma1l.com", "gmail.com")], 3) == 0.889


def test_lookalike_filter_loses_nothing(spark):
    """The native filter keeps every pair the exact ratio accepts."""
    from difflib import SequenceMatcher

    from lurelens import rules

    names = ["gooogle.com", "amaz0n.com", "slackk.com", "zoom.com", "xcom", "linkedln.com", "office.co", "bankofamerlca.com"]
    df = spark.createDataFrame([(n,) for n in names], "domain string")
    kept = {(r.base, r.brand) for r in D.lookalike_domains(df, "domain").collect()}
    want = {(n, b) for n in names for b in rules.TRUSTED_DOMAINS if n != b and SequenceMatcher(None, n, b).ratio() > 0.8}
    assert kept == want


def test_digit_substitution_quirk(spark):
    rows = [("google.com", 1), ("g00gle.com", 0), ("apple.com", 1), ("example.com", 0)]
    for r in spark.createDataFrame(rows, "d string, want int").select("want", D.digit_substitution(F.col("d")).alias("got")).collect():
        assert r.got == r.want


def test_blocked_addresses_follow_the_registry(spark):
    addresses = [
        "8.8.8.8", "10.0.0.1", "100.64.0.1", "127.0.0.1", "169.254.1.1", "172.16.0.1", "172.32.0.1", "192.0.0.1", "192.0.0.9", "192.0.2.1",
        "192.168.1.1", "198.18.0.1", "198.51.100.7", "203.0.113.9", "224.0.0.1", "240.0.0.1", "255.255.255.255", "0.0.0.0", "1.1.1.1",
        "::1", "::", "fe80::1", "fc00::1", "ff02::1", "2001:db8::1", "2001:4860:4860::8888", "2606:4700::1111", "2002::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8",
        "2001:20::1", "2001:1::1", "64:ff9b::1",
    ]

    def reference(a):
        ip = ipaddress.ip_address(a)
        return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified

    got = spark.createDataFrame([(a,) for a in addresses], "a string").select("a", U.blocked_host(F.col("a")).alias("b")).collect()
    assert {r.a: r.b for r in got} == {a: reference(a) for a in addresses}


def test_scannable_urls(spark):
    df = spark.createDataFrame(
        [(1, ["https://A.com/x", "http://10.0.0.1/", "ftp://x.com", None], "see https://a.com/X, www.b.org. and http://localhost/ http://[fe80::1]/")],
        "id int, urls array<string>, body string")
    got = [(r.url, r.host) for r in U.scannable_urls(df, "id").orderBy("pos").collect()]
    assert got == [("https://A.com/x", "a.com"), ("https://www.b.org", "www.b.org")]


def test_link_mismatch_variants(spark):
    rows = [("portal.example.com", "https://files.example.net/p"), ("a.co", "https://b.com"), ("Click", "https://b.com"), ("http://b.com/x", "https://b.com")]
    df = spark.createDataFrame(rows, "t string, h string")
    got = [tuple(r) for r in df.select(*[U.link_mismatch(F.col("t"), F.col("h"), v) for v in ("analyzer", "structural", "extension")]).collect()]
    assert got == [(True, True, False), (True, False, False), (False, False, False), (False, True, False)]


def test_ladder_bounds(spark):
    rows = [(0.75, "MEDIUM", "MEDIUM"), (0.76, "CRITICAL", "CRITICAL"), (0.45, "MEDIUM", "LOW"), (0.44, "LOW", "LOW")]
    for r in spark.createDataFrame(rows, "p double, a string, b string").select(
        "*", ladder(F.col("p"), "operational").alias("x"), ladder(F.col("p"), "late_fusion").alias("y")).collect():
        assert (r.x, r.y) == (r.a, r.b)


def test_hosts_keep_odd_characters(spark):
    rows = [("https://user:pw@Ex_ample.com:8080/p", "ex_ample.com"), ("//h.org/x", "h.org"), ("mailto:a@b.c", ""), ("https://[::1]:80/", "::1"), ("https://a.com./x", "a.com")]
    for r in spark.createDataFrame(rows, "u string, want string").select("want", L.hostname(F.col("u")).alias("got")).collect():
        assert r.got == r.want


def test_near_duplicates_match_brute_force(spark, tmp_path):
    """Copies, a large loose group of near-copies and unrelated texts."""
    import math
    from collections import Counter

    from lurelens.operators import neardup as N

    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        words = list(base)
        for j in range(i % 4):
            words[(i * 7 + j * 40) % 120] = f"x{i}_{j}"
        texts[i] = " ".join(words)
    texts[60], texts[61], texts[62], texts[63] = "Hello", "hello", "", "a b"
    for i in range(64, 80):
        texts[i] = " ".join(f"u{i}_{k}" for k in range(30))
    df = spark.createDataFrame(list(texts.items()), "id long, text string")

    def vector(text):
        w = text.lower().split()
        return Counter(tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))) if w else Counter()

    vectors = {i: vector(t) for i, t in texts.items()}

    def cosine(a, b):
        na, nb = (math.sqrt(sum(v * v for v in x.values())) for x in (a, b))
        return sum(v * b[k] for k, v in a.items()) / (na * nb) if na and nb else 0

    want = {b for b in texts if any(a < b and cosine(vectors[a], vectors[b]) >= 0.95 - 1e-9 for a in texts)}
    got = {r.id for r in N.near_duplicates(df, str(tmp_path)).collect()}
    assert got == want and 61 in got and len(want) > 20


def test_text_columns_hold_few_strings_at_a_time(spark, monkeypatch):
    """Batches of any size become strings a few texts at a time; results do not depend on it."""
    import math

    import pyarrow as pa

    from lurelens.functions import text as X

    texts = ["abab", None, "", "zzz", "ünï\U0001f600"] * 30
    taken = []

    class Texts:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def slice(self, at, n):
            return Texts(self.values[at:at + n])

        def to_pylist(self):
            taken.append(len(self.values))
            return self.values

    got = X._entropies(Texts(texts)).to_pylist()
    assert max(taken) <= X.TEXTS_AT_ONCE < len(texts) == sum(taken)
    assert got[:5] == pytest.approx([1.0, 0.0, 0.0, 0.0, math.log2(4)]) and got[5:] == got[:-5]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    rows = df.select("id", X.entropy(F.col("t")).alias("e"), X.lexicon_hits(F.col("t"), ["ab", "z"], ["zz"]).alias("h")).orderBy("id").collect()
    assert [r.e for r in rows] == X._entropies(pa.array(texts)).to_pylist()
    assert [r.h for r in rows[:5]] == [[2, 0], [0, 0], [0, 0], [3, 1], [0, 0]]


def test_prefixes_bound_the_cosine_and_spare_most_vectors(spark, tmp_path):
    """No candidate is lost by the bound, and texts that share few leading shingles are not read again."""
    import numpy as np

    from lurelens.operators import neardup as N

    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 300)
    texts = [np.concatenate([rng.permutation(base)[: 300 - cut], rng.integers(0, 1 << 40, cut), base[: i % 3]]) for i, cut in enumerate([0, 2, 5, 8, 12, 20, 40, 150] * 4)]
    met = np.bincount(np.concatenate(texts) % N.ORDER_BUCKETS, minlength=N.ORDER_BUCKETS)
    for threshold in (0.95, 0.7):
        heads = [N._prefix(t, met, threshold**2 - N.SLACK) for t in texts]
        spared = 0
        for i, x in enumerate(texts):
            for j, y in enumerate(texts[:i]):
                if len(heads[i][0]) and len(heads[j][0]):
                    cosine, bound = N._dot(*N._vector(x), *N._vector(y)), N._bound(met, *((lead, weight, beyond) for lead, weight, _, beyond in (heads[i], heads[j])))
                    assert bound >= cosine - N.SLACK
                    spared += cosine < bound < threshold
        assert spared > 0
    words = [" ".join(f"w{(i * 37 + k) % 900}" for k in range(60)) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(words + [words[3] + " more"])], "id long, text string")
    assert [r.id for r in N.near_duplicates(df, str(tmp_path)).collect()] == [40]
    assert not [p for p in tmp_path.iterdir() if "keys" in spark.read.parquet(str(p)).columns or "shingles" in spark.read.parquet(str(p)).columns]
    led = spark.read.parquet(str(tmp_path / "members")).filter("a < id").select("a", "id").distinct().count()
    assert 1 <= spark.read.parquet(str(tmp_path / "led_near")).count() < led
    assert N.marked(df, df.filter("id IN (3, 7)")).count() == 2


def test_texts_without_partners_leave_before_the_pairs(spark, tmp_path):
    """A text with enough shingles of its own has no prefix, copies of it or not; near-copies, copies and short texts stay."""
    import numpy as np

    from lurelens.operators import neardup as N

    rng = np.random.default_rng(3)
    common = [f"c{k}" for k in range(80)]
    texts = [" ".join([*common, *(f"u{i}_{k}" for k in rng.permutation(120))]) for i in range(40)]
    near = [t.replace("c5 ", "other ") for t in texts[:4]]
    rows = texts + near + texts[4:8] + ["hello", "Hello", "", None]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
    assert sorted(r.id for r in N.near_duplicates(df, str(tmp_path)).collect()) == [*range(40, 48), 49]
    heads = {r.id for r in spark.read.parquet(str(tmp_path / "prefixes")).collect()}
    assert {0, 1, 2, 3, 40, 41, 42, 43} <= heads and len(heads) < 15
    left = {r.id for r in spark.read.parquet(str(tmp_path / f"left_{N.ASKED - 1}")).collect()}
    assert heads <= left and 48 in left
    # at a low threshold the common half alone may make a pair: nothing leaves
    firsts = df.filter("id < 40").select("id", F.xxhash64(F.sha2(F.lower("text"), 256)).alias("copy"))
    assert N.with_partners(df.filter("id < 40"), firsts, str(tmp_path / "low"), 0.5, "text").count() == 40
