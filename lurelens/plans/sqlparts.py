"""SQL twins of the derived views and of the shared column builders (DuckDB dialect)."""

from __future__ import annotations

from lurelens import rules
from lurelens.plans import fixtures


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5e0) / 1e6)"


def hits(text: str, words) -> str:
    """Non-overlapping occurrences, summed over keywords."""
    return "(" + " + ".join(
        f"((length({text}) - length(replace({text}, {lit(w)}, ''))) // {len(w)})" for w in words
    ) + ")"


def any_in(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def rx(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def any_rx(text: str, patterns) -> str:
    return "(" + " OR ".join(rx(text, p) for p in patterns) + ")"


def rx_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {lit(pattern)}))"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"


def flag(cond: str) -> str:
    return f"CAST(coalesce({cond}, false) AS INT)"


def netloc(u: str) -> str:
    return f"lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"


def netloc_host(u: str) -> str:
    return f"split_part({netloc(u)}, ':', 1)"


def host(u: str) -> str:
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:@]*)"
    return f"regexp_replace(regexp_replace(lower(regexp_extract({u}, {lit(pattern)}, 1)), '^\\[|\\]$', '', 'g'), '\\.+$', '')"


def lenient_host(u: str) -> str:
    return host(f"CASE WHEN regexp_matches(trim({u}), '^https?://') THEN trim({u}) ELSE 'https://' || trim({u}) END")


def ends_any(text: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({text}, {lit(s)})" for s in suffixes) + ")"


def base(domain: str, variant: str = "trust") -> str:
    slds = in_list(rules.SECOND_LEVEL[variant])
    clean = f"rtrim(lower({domain}), '.')" if variant == "trust" else domain
    p = f"string_split({clean}, '.')"
    return (
        f"CASE WHEN len({p}) >= 3 AND {p}[-2] IN {slds} THEN {p}[-3] || '.' || {p}[-2] || '.' || {p}[-1] "
        f"WHEN len({p}) >= 2 THEN {p}[-2] || '.' || {p}[-1] ELSE {domain} END"
    )


def last_at(address: str) -> str:
    return f"CASE WHEN contains({address}, '@') THEN lower(trim(trim(string_split({address}, '@')[-1], '>'))) ELSE '' END"


def ladder(x: str, variant: str) -> str:
    rungs, bottom = rules.LADDERS[variant]
    parts = [
        f"WHEN {x} {'>=' if closed else '>'} CAST({bound} AS DOUBLE) THEN {lit(name)}" for bound, closed, name in rungs
    ]
    return "CASE " + " ".join(parts) + f" ELSE {lit(bottom)} END"


_ROWS = ",\n".join(
    "(" + ", ".join(lit(v) for v in (i, *row)) + ")" for i, row in enumerate(fixtures.TEMPLATES)
)
TRUSTED = "SELECT * FROM (VALUES " + ", ".join(
    f"({lit(d)}, {lit(c)}, {arr(s)}::VARCHAR[])" for d, (c, s) in rules.TRUSTED_DOMAINS.items()
) + ") AS x(base, category, subs)"
BRANDS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {lit(p)}, {lit(b)})" for i, (p, b) in enumerate(rules.IMPERSONATION_PATTERNS)
) + ") AS x(k, pattern, brand)"

PARTS = {
    "templates": ((), f"SELECT * FROM (VALUES {_ROWS}) AS x(t, subject, from_email, reply_to, snippet, url, label)"),
    "emails": (("templates",), f"""
SELECT d.doc_id AS id, t.subject, t.from_email, t.reply_to, CAST(t.label AS INT) AS label,
  t.snippet || chr(10) || d.text AS body, d.source,
  CASE WHEN d.doc_id % 4 = 0 THEN 'team@company.com, ops@company.com' ELSE 'user@company.com' END AS to_email,
  CASE d.doc_id % 3 WHEN 0 THEN 'pass (sender permitted)' WHEN 1 THEN 'fail (not permitted)' END AS h_spf,
  CASE WHEN d.doc_id % 2 = 0 THEN 'v=1; a=rsa-sha256' END AS h_dkim,
  CASE WHEN d.doc_id % 6 = 0 THEN '<bounce@mailer.example.net>' END AS h_return,
  CASE WHEN d.doc_id % 5 = 0 THEN 'a@company.com, b@company.com, ' END AS h_cc,
  CASE d.doc_id % 7 WHEN 0 THEN ['Invoice.ZIP'] WHEN 1 THEN ['notes.pdf', 'photo.png'] ELSE [] END AS files,
  CASE WHEN d.doc_id % 11 = 0 THEN []::VARCHAR[]
    ELSE list_concat([t.url],
      list_concat(CASE WHEN t.t = 15 THEN {arr(fixtures.EXTRA_URLS)} ELSE []::VARCHAR[] END,
                  CASE WHEN p.url IS NOT NULL THEN [p.url] ELSE []::VARCHAR[] END)) END AS urls,
  e.ts
FROM documents d JOIN templates t ON t.t = d.doc_id % 20
LEFT JOIN pages p ON d.doc_id % 3 <> 0 AND p.page_id = d.doc_id % (SELECT count(*) FROM pages)
LEFT JOIN events e ON e.event_id = d.doc_id"""),
    "email_urls": (("emails",), """
SELECT e.id, u.pos, u.url FROM emails e,
  LATERAL (SELECT unnest(e.urls) AS url, unnest(range(len(e.urls))) AS pos) u"""),
    "votes": ((), f"""
SELECT doc_id AS id, unnest([quality, toxic, {arr([r[5] for r in fixtures.TEMPLATES])}[(doc_id % 20 + 1)::INT]]) AS label FROM labels"""),
    "scan_events": ((), """
SELECT user_id AS scan_id, event_id, ts, value,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running'
    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status FROM events"""),
    "predictions": (("emails",), """
SELECT e.id, e.label, e.source, m.model, least(((e.id * m.c) % 101) / 1e2, 1e0) AS probability
FROM emails e, (VALUES ('alpha', 37), ('beta', 53), ('gamma', 71)) AS m(model, c)"""),
    "url_hosts": (("templates",), f"""
SELECT domain, min(m) AS m FROM (
  SELECT {host('url')} AS domain, page_id AS m FROM pages UNION ALL SELECT {host('url')}, t FROM templates) GROUP BY domain"""),
    "dns_records": (("url_hosts",), f"""
SELECT domain, 'A' AS rdtype, '198.51.100.' || (m % 250) AS value FROM url_hosts WHERE m % 5 <> 0
UNION ALL SELECT domain, 'NS', 'ns1.' || domain FROM url_hosts WHERE (m + 1) % 5 <> 0
UNION ALL SELECT domain, 'MX', 'mx1.' || domain FROM url_hosts WHERE (m + 2) % 5 <> 0
UNION ALL SELECT domain, 'TXT', CASE WHEN m % 3 = 0 THEN 'site-check=1' ELSE 'v=spf1 include:mail -all' END FROM url_hosts WHERE (m + 3) % 5 <> 0
UNION ALL SELECT '_dmarc.' || domain, 'TXT', 'v=DMARC1; p=none' FROM url_hosts WHERE m % 2 = 0"""),
    "reputation_keys": (("url_hosts",), """
SELECT 'domain' AS kind, domain AS key, m FROM url_hosts
UNION ALL SELECT 'url', lower(url), min(page_id) FROM pages GROUP BY lower(url)"""),
    "reputation": (("reputation_keys",), f"""
SELECT kind, key, m % 7 + s.step AS malicious, m % 5 AS suspicious, 60 AS harmless, 10 AS undetected,
  CASE m % 9 WHEN 0 THEN 'queued' WHEN 1 THEN 'rate_limited' ELSE 'completed' END AS status,
  TIMESTAMP '{fixtures.OBSERVED}' + to_minutes(CAST(m % 600 AS BIGINT)) + to_hours(s.step) AS observed_at
FROM reputation_keys, (VALUES (0), (1)) AS s(step)"""),
    "trusted": ((), TRUSTED),
    "brands": ((), BRANDS),
}


def _order(names, seen):
    for name in names:
        needs, _ = PARTS[name]
        _order(needs, seen)
        if name not in seen:
            seen.append(name)
    return seen


def sql(body: str, *needs: str, **own: str) -> str:
    """``WITH`` the shared views a twin needs, its own steps, then the body."""
    views = [f"{n} AS ({PARTS[n][1]})" for n in _order(needs, [])]
    views += [f"{n} AS ({b})" for n, b in own.items()]
    return ("WITH " + ",\n".join(views) + "\n" if views else "") + body
