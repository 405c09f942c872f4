"""Rule tables. All of them are parameters of the operators.

FIXED VALUES: the word lists, domains, patterns, weights and bounds in this module must equal the
published rules for results to agree. They are data, not logic, and all are of small constant size.
"""

from __future__ import annotations

# -- shorteners, by rule set -------------------------------------------------
SHORTENERS = {
    "analyzer": [
        "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "short.link", "is.gd", "v.gd",
        "buff.ly", "adf.ly", "j.mp",
    ],
    "operational": [
        "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly",
        "lnkd.in",
    ],
    "forensics": [
        "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly",
    ],
    "extension": [
        "bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly",
    ],
}
SHORTENER_PATTERNS = {
    "inventory": r"(?i)^(bit\.ly|tinyurl|t\.co|goo\.gl|is\.gd|rb\.gy|cutt\.ly)",
    "web": r"bit\.ly|tinyurl|goo\.gl|ow\.ly|short\.link",
    "web_class": r"bit\.ly|tinyurl|goo\.gl|ow\.ly",
}

# -- suspicious top-level domains --------------------------------------------
SUSPICIOUS_TLDS = {
    "analyzer": [
        ".ru", ".cn", ".tk", ".ml", ".ga", ".cf", ".top", ".download", ".stream", ".webcam",
        ".faith", ".racing",
    ],
    "operational": [".xyz", ".top", ".club", ".link", ".win", ".bid"],
    "api": [".ru", ".tk", ".ml", ".ga"],
}

# -- keyword lexicons --------------------------------------------------------
URGENCY = [
    "urgent", "immediate", "action required", "asap", "immediately", "quickly", "now", "today",
    "tonight",
]
CREDENTIAL = [
    "password", "login", "credentials", "username", "authenticate", "verify", "confirm", "email",
    "account", "access", "authorized",
]
ACTION_CTA = [
    "click", "click here", "tap", "open", "download", "update", "proceed", "start", "begin",
    "continue",
]
THREAT = [
    "suspend", "block", "limited", "locked", "risk", "violation", "unauthorized", "problem",
    "issue", "error", "compromised",
]
LEGITIMACY = [
    "regards", "sincerely", "thank you", "appreciate", "best", "warmly", "professional", "legal",
    "official",
]
LEXICONS = {
    "full": {
        "urgency": URGENCY, "credential": CREDENTIAL, "action_cta": ACTION_CTA,
        "threat": THREAT, "legitimacy": LEGITIMACY,
    },
    "declared": {
        "urgency": URGENCY[:7], "credential": CREDENTIAL[:9], "action_cta": ACTION_CTA[:8],
        "threat": THREAT[:9], "legitimacy": LEGITIMACY[:7],
    },
}
CTA_PRESENCE = ["click", "verify"]
LEGITIMACY_SHORT = ["regards", "sincerely", "thank you", "professional", "official"]
OPERATIONAL_URGENCY = ["urgent", "immediate", "action required", "suspend", "verify now", "alert"]
OPERATIONAL_SENSITIVE = ["password", "login", "bank", "account", "ssn", "credit card", "billing"]
HYBRID_SUBJECT_URGENT = ["urgent", "verify", "confirm", "action", "click"]
HYBRID_SUBJECT_REPLY = ["re:", "fwd:", "---"]
HYBRID_SHORT_DOMAIN = ["bit.ly", "tinyurl", "short"]
HYBRID_SHORT_URL = ["bit.ly", "tinyurl"]
FORENSIC_URL_KEYWORDS = ["verify", "update", "secure", "account"]
EXPLAIN_BODY_KEYWORDS = ["password", "account", "verify", "click", "login"]

# -- trusted senders: base domain -> (category, known subdomains) -------------
TRUSTED_DOMAINS = {
    "google.com": ("tech", ["mail", "accounts", "support", "ads", "cloud", "workspace", "meet", "drive", "docs", "calendar"]),
    "gmail.com": ("tech", []),
    "googlemail.com": ("tech", []),
    "youtube.com": ("tech", ["studio", "music"]),
    "microsoft.com": ("tech", ["support", "account", "office", "teams", "azure", "outlook", "onedrive"]),
    "outlook.com": ("tech", []),
    "hotmail.com": ("tech", []),
    "live.com": ("tech", []),
    "office365.com": ("tech", []),
    "office.com": ("tech", []),
    "apple.com": ("tech", ["support", "id", "icloud", "store"]),
    "icloud.com": ("tech", []),
    "amazon.com": ("ecommerce", ["aws", "support", "seller"]),
    "amazon.in": ("ecommerce", ["aws", "support", "seller"]),
    "amazon.co.uk": ("ecommerce", []),
    "amazonaws.com": ("cloud", ["s3", "ec2", "ses", "sns"]),
    "sbi.co.in": ("bank", ["onlinesbi", "retail"]),
    "onlinesbi.sbi": ("bank", []),
    "hdfcbank.com": ("bank", ["netbanking"]),
    "icicibank.com": ("bank", ["infinity"]),
    "axisbank.com": ("bank", ["omni"]),
    "kotak.com": ("bank", ["netbanking"]),
    "rbi.org.in": ("bank", []),
    "paypal.com": ("finance", ["www"]),
    "stripe.com": ("finance", ["dashboard"]),
    "chase.com": ("bank", ["secure"]),
    "bankofamerica.com": ("bank", ["secure"]),
    "wellsfargo.com": ("bank", ["www"]),
    "facebook.com": ("social", ["m", "business"]),
    "meta.com": ("social", ["about"]),
    "instagram.com": ("social", []),
    "twitter.com": ("social", []),
    "x.com": ("social", []),
    "linkedin.com": ("social", ["www"]),
    "github.com": ("tech", ["support"]),
    "dropbox.com": ("tech", ["www"]),
    "zoom.us": ("tech", ["us02web", "us04web"]),
    "slack.com": ("tech", []),
    "notion.so": ("tech", []),
}
GOVERNMENT_PATTERNS = [
    r"\.gov$", r"\.gov\.in$", r"\.gov\.uk$", r"\.gov\.au$", r"\.gc\.ca$", r"\.gov\.sg$",
    r"\.nic\.in$", r"\.edu$", r"\.edu\.in$", r"\.ac\.in$", r"\.mil$",
]
IMPERSONATION_PATTERNS = [
    (r"g[o0]{2}g[l1]e|go+g[l1]e|goog[l1]e[.\-]|googie|g00gle", "google"),
    (r"gma[i1l][l1]|gmai[l1][.\-]", "gmail"),
    (r"micros[o0]ft|micr[o0]s[o0]ft|microsft|micr0soft", "microsoft"),
    (r"[o0]ut[l1][o0]{2}k|outl00k", "outlook"),
    (r"app[l1]e[.\-]|app[l1]e[0-9]|aple[.\-]|appl[e3]", "apple"),
    (r"[i1]c[l1][o0]ud|ic[l1]oud", "icloud"),
    (r"amaz[o0]n[.\-]|amazn|amaz0n", "amazon"),
    (r"paypa[l1][.\-]|pay-?pa[l1]|payp[a@][l1]", "paypal"),
    (r"sbi[.\-]co|sbi-online|on[l1]inesbi", "sbi"),
    (r"hdfc[.\-]bank|hdfcb[a@]nk", "hdfc"),
    (r"[i1]c[i1]c[i1]bank|icicib[a@]nk", "icici"),
    (r"face[b6]o{1,2}k|faceb00k|facbook", "facebook"),
    (r"[l1]inked[i1]n|linkedln|l[i1]nkedin", "linkedin"),
    (r"secure-?bank|bank-?login|bank-?verify|bank-?update", "generic_bank"),
    (r"login-?secure|verify-?account|account-?update", "generic_phishing"),
]
SECOND_LEVEL = {
    "analyzer": ["co", "com", "org", "gov", "edu"],
    "trust": ["co", "com", "org", "net", "ac", "gov", "edu"],
}
TYPO_COMPANIES = ["google", "amazon", "apple", "microsoft", "facebook", "twitter", "linkedin"]

# -- web patterns ------------------------------------------------------------
HOMOGRAPH_PATTERNS = [
    r"(?i)paypa[l1]|pay-pal|paypa\.l", r"(?i)amaz[o0]n|amazn", r"(?i)app[l1]e|aple",
    r"(?i)micros[o0]ft|microsft", r"(?i)goog[l1]e|gogle", r"(?i)face[b6]o?ok|facebooke",
]
FREEMAIL = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "mail.com", "aol.com",
    "protonmail.com", "yandex.com",
]
THROWAWAY_PATTERN = r"(?i)\d{1,3}-\d{1,3}-\d{1,3}-\d{1,3}|temporary|temp-mail|10minutemail"
BRAND_WORDS = ["paypal", "amazon", "apple", "microsoft", "google", "facebook", "bank"]
SUSPICIOUS_URL_PATTERNS = [
    r"bit\.ly|tinyurl|goo\.gl|ow\.ly|short\.link",
    r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    r"(?i)%[0-9a-f]{2}",
    r"(?i)js:|data:|vbscript:",
    r"(?i)paypal|amazon|apple|microsoft|bank|verify|confirm|update|urgent",
    r"[а-яёА-ЯЁ]",
    r"xn--",
    r"[0-9]+%",
    r"(?i)login|signin|authenticate|credential|password",
]
SUSPICIOUS_LINK_PATTERN = r"(?i)login|verify|account|password|update|secure|confirm|banking|paypal|click here"
# name -> (pattern, score, red flag)
CONTENT_RISK = {
    "passwords": (r"(?i)(?:password|pwd|pass)\s*[:=]\s*(?:\*+|•+|xxx|redacted|click here|enter)", 30, "Password request detected"),
    "credit_cards": (r"(?:\d{4}[-\s]?){3}\d{4}|[0-9]{13,19}", 40, "Financial credential request"),
    "security_questions": (r"(?i)(?:security question|mother's maiden name|pet name|favorite book)", 25, "Security question requests"),
    "account_activation": (r"(?i)(?:account (?:suspended|locked|disabled|inactive)|verify your account|confirm identity|urgent|immediate action)", 15, "Account verification scam"),
    "payment_requests": (r"(?i)(?:click to pay|update payment|billing information|credit card details)", 20, "Unauthorized payment request"),
    "urgency_language": (r"(?i)(?:urgent|immediate|asap|act now|within \d+ hours?|verify now|confirm now)", 10, "High-pressure tactics"),
}
RED_FLAG_ORDER = [
    "passwords", "credit_cards", "urgency_language", "security_questions", "account_activation",
    "payment_requests",
]
SUBJECT_URGENT_PATTERN = r"(?i)(?:urgent|immediate|asap|act now|within \d+ hours?|verify now|confirm now|click here|today)"
SUBJECT_EXECUTIVE_PATTERN = r"(?i)(?:ceo|cfo|executive|boss|management|director|urgent request|confidential|private)"
SUBJECT_CATEGORIES = {
    "account_issues": r"(?i)(account|verify|confirm|update|suspended|locked|disabled)",
    "financial": r"(?i)(payment|billing|invoice|refund|wire|transfer)",
    "urgency": r"(?i)(urgent|immediate|asap|within \d+ hours)",
    "action": r"(?i)(click|confirm|verify|update|action required)",
}
SPF_FAIL_PATTERN = r"(?i)spf.*(?:softfail|fail|neutral)"
DKIM_FAIL_PATTERN = r"(?i)dkim.*(?:fail|none)"
NULL_RETURN_PATTERN = r"(?m)^Return-Path:.*<>"

# -- indicators of compromise ------------------------------------------------
ADDRESS_PATTERN = r"(?i)[a-zA-Z0-9._%-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
IPV4_PATTERN = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
IPV6_PATTERN = r"(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}"
MAC_PATTERN = r"(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})"
PORT_PATTERN = r":(\d{2,5})\b"
DNS_TEXT_PATTERN = r"(?i)(?:DNS|MX|SPF|DKIM|DMARC)\s*[:=]\s*([^\n\r]+)"

# -- attachments -------------------------------------------------------------
RISKY_EXTENSIONS = {
    "used": [".exe", ".bat", ".scr", ".vbs", ".js", ".zip", ".rar"],
    "declared": [".exe", ".bat", ".scr", ".vbs", ".js", ".zip", ".rar", ".7z", ".cab", ".msi", ".com", ".pif"],
}

# -- labels and stop words ---------------------------------------------------
LABELS = {
    "default": {"legitimate": 0, "ham": 0, "legitimate_email": 0, "phishing": 1, "spam": 1, "phishing_email": 1},
    "spam_is_legitimate": {"legitimate": 0, "ham": 0, "legitimate_email": 0, "phishing": 1, "spam": 0, "phishing_email": 1},
}
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it",
    "its", "of", "on", "or", "that", "the", "to", "was", "will", "with", "you", "your",
]

# -- risk ladders: rungs from the top, (bound, bound is included, level); below all: last level --
LADDERS = {
    "operational": ([(0.75, False, "CRITICAL"), (0.45, True, "MEDIUM")], "LOW"),
    "late_fusion": ([(0.75, False, "CRITICAL"), (0.45, False, "MEDIUM")], "LOW"),
    "pipeline": ([(0.95, False, "CRITICAL"), (0.85, False, "HIGH"), (0.70, False, "MEDIUM")], "LOW"),
    "hybrid": ([(0.9, False, "CRITICAL"), (0.7, False, "HIGH"), (0.5, False, "MEDIUM")], "LOW"),
    "ensemble": ([(0.8, False, "CRITICAL"), (0.6, False, "HIGH"), (0.4, False, "MEDIUM")], "LOW"),
    "safety": ([(75, True, "LOW"), (50, True, "MEDIUM"), (25, True, "HIGH")], "CRITICAL"),
    "thirds": ([(0.66, False, "HIGH"), (0.33, False, "MEDIUM")], "LOW"),
    "external": ([(75, True, "high_external_risk"), (40, True, "medium_external_risk"), (15, True, "low_external_risk")], "no_major_external_warning"),
    "popup": ([(60, True, "High Risk"), (30, True, "Medium Risk"), (0, False, "Low Risk")], "Clean"),
    "content": ([(60, True, "critical"), (40, True, "high"), (20, True, "medium")], "low"),
}
ACTIONS = {"CRITICAL": "BLOCK_AND_REPORT", "MEDIUM": "WARN", "LOW": "ALLOW"}
RISK_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}

# -- text cleaning -----------------------------------------------------------
SIGNATURE_PATTERNS = [
    r"(?is)--\s*\n.*?(regards|thanks|sincerely|best)",
    r"(?is)(Sent from|Sent on).*",
    r"(?is)___\n.*?\n___",
]
FOOTER_PATTERNS = [
    r"(?is)-----\s*(Original Message|Forwarded Message).*",
    r"(?is)\[cid:.*?\]",
    r"(?is)(Disclaimer|Copyright|Confidential):.*?(?=\n\n|\z)",
]
PHONE_PATTERN = r"(\+\d{1,3})?[\s.-]?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
SENDER_PHONE_PATTERN = r"\+?1?\s?\(?[0-9]{3}\)?[\s.-][0-9]{3}[\s.-][0-9]{4}"
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&amp;", "&"),
]
URL_EXTRACT = {
    "loader": r'https?://[^\s\)<>"\]]*',
    "plain": r'https?://[^\s\)<>"]*',
    "adapter": r"(?i)https?://[^\s]+",
    "scanner": r"""(?i)(?:https?://[^\s<>"')\]]+|www\.[^\s<>"')\]]+)""",
}
TRAILING_PUNCTUATION = ".,;:!?)>]}'\""
BLOCKED_HOSTS = ["localhost", "localhost.localdomain", "ip6-localhost", "ip6-loopback"]
# IPv4 ranges that are never sent to an outside scanner: (first, last) address as integers
BLOCKED_IPV4 = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "239.255.255.255"), ("240.0.0.0", "255.255.255.255"),
]

# -- weights -----------------------------------------------------------------
HEURISTIC_WEIGHTS = {
    "api": {"shortened": 0.4, "mismatch": 0.4, "sender_dns": 0.5, "url_dns": 0.4, "urgency_div": 20.0, "sensitive": 0.1},
    "fusion_text": {"shortened": 0.4, "mismatch": 0.5, "sender_dns": 0.9, "url_dns": 0.7, "urgency_div": 10.0, "sensitive": 0.1},
    "fusion_rules": {"shortened": 0.6, "mismatch": 0.7, "sender_dns": 0.9, "url_dns": 0.7, "urgency_div": 20.0, "sensitive": 0.0},
}
THRESHOLDS = [("default", 0.5), ("precision", 0.65), ("recall", 0.35)]
