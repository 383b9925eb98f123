"""Cleaning and identity keys as column expressions. The families differ on purpose: leads, registry and outreach each have their own key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing value.
LEAD_MISSING = ("", "not available", "n/a", "none", "null")
REGISTRY_MISSING = ("", "n/a", "none", "null", "not available", "unknown")

# Hosts that say nothing about a company.
WEAK_DOMAINS = (
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com",
    "youtube.com", "wix.com", "wixsite.com", "wixpress.com",
    "sentry-next.wixpress.com", "o2switch.fr", "wordpress.com",
    "blogspot.com", "github.io", "google.com", "googleusercontent.com",
    "example.com", "example.org", "example.net", "exemple.com",
    "domaine.com", "domain.com", "mail.com", "email.com",
    "gmail.com", "outlook.com", "outlook.fr", "hotmail.com", "yahoo.com",
)

# Query parameters that only track.
TRACKING_KEYS = (
    "fbclid", "gclid", "msclkid", "ref", "referrer", "source", "src",
    "campaign", "campaignid", "trk", "trackingid",
)
TRACKING_PREFIXES = ("utm_", "__cf_chl_", "cf_chl_")

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def clean(value: Column, missing: tuple[str, ...] = LEAD_MISSING) -> Column:
    """white space collapsed; words for a missing value, and null, become ''."""
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.lower(text).isin(*missing), "").otherwise(text)


def text_value(value: Column) -> Column:
    """P20: trimmed; null is ''."""
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def first_filled(*values: Column, missing: tuple[str, ...] = LEAD_MISSING) -> Column:
    """The first value that is not blank once cleaned, else ''."""
    return F.coalesce(*[F.nullif(clean(v, missing), F.lit("")) for v in values], F.lit(""))


def lead_name_key(value: Column) -> Column:
    return F.lower(clean(value))


def registry_name_key(value: Column) -> Column:
    """Registry key; full-width and ligature forms of ASCII fold as under NFKC."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    folded = F.translate(clean(value, REGISTRY_MISSING), wide + " 　", "".join(chr(c) for c in range(0x21, 0x7F)) + "  ")
    for ligature, letters in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        folded = F.replace(folded, F.lit(ligature), F.lit(letters))
    return F.lower(folded)


def outreach_name_key(value: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"(?U)[^\p{Alnum}]", "")


def phone_key(value: Column) -> Column:
    """digits; '' for fewer than six."""
    digits = F.regexp_replace(clean(value), r"\D", "")
    return F.when(F.length(digits) >= 6, digits).otherwise("")


def address_key(value: Column) -> Column:
    """words, lower case, single spaces."""
    return F.trim(F.regexp_replace(registry_name_key(value), r"(?U)[^\w]+", " "))


def host(value: Column) -> Column:
    """The host of an address with or without scheme, lower case, without user, port and final dots; '' if none."""
    rest = F.regexp_replace(clean(value), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    authority = F.regexp_extract(F.regexp_replace(rest, r"^//", ""), r"^([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(F.lower(bare), r"\.+$", "")


def domain(value: Column) -> Column:
    """the host without a leading www."""
    return F.regexp_replace(host(value), r"^www\.", "")


#: F7, fixed values: suffixes of two labels
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "com.tn", "com.au", "co.nz", "com.br", "co.jp", "com.sg")


def registrable_domain(name: Column) -> Column:
    """the last two labels, or three under a suffix of two labels."""
    labels = F.split(name, r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    return F.when(F.size(labels) < 2, name).when((F.size(labels) >= 3) & last(2).isin(*TWO_LABEL_SUFFIXES), last(3)).otherwise(last(2))


def domain_matches(name: Column, expected: Column) -> Column:
    """F8: equal or a subdomain."""
    return (expected != "") & ((name == expected) | F.endswith(name, F.concat(F.lit("."), expected)))


def trustworthy_domain(name: Column, weak: tuple[str, ...] = WEAK_DOMAINS) -> Column:
    """F9."""
    bad = F.lit(False)
    for w in weak:
        bad = bad | (name == w) | F.endswith(name, F.lit("." + w))
    return (name != "") & F.contains(name, F.lit(".")) & ~bad


def job_url(value: Column) -> Column:
    """lower scheme and host, default port, fragment and tracking parameters dropped, parameters sorted, no final slash; '' if not http(s)."""
    text = F.trim(F.coalesce(value, F.lit("")))
    full = F.when(F.rlike(text, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), text).when(text == "", "").otherwise(F.concat(F.lit("https://"), text))
    part = lambda n: F.regexp_extract(full, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", n)
    scheme, path = F.lower(part(1)), part(3)
    name = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(part(2), r"^.*@", "")), r":\d*$", ""), r"\.+$", "")
    port = F.regexp_extract(part(2), r":(\d+)$", 1)
    place = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), name).otherwise(F.concat(name, F.lit(":"), port))
    tidy = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, r"/+$", ""))
    decoded = lambda x: F.try_url_decode(x)
    encoded = lambda x: F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))
    pair = lambda p: F.struct(
        F.lower(decoded(F.regexp_extract(p, r"^([^=]*)", 1))).alias("folded"),
        decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("value"),
        decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("key"),
    )
    tracking = lambda k: k.isin(*TRACKING_KEYS) | F.startswith(k, F.lit(TRACKING_PREFIXES[0])) | F.startswith(k, F.lit(TRACKING_PREFIXES[1])) | F.startswith(k, F.lit(TRACKING_PREFIXES[2]))
    pairs = F.filter(F.transform(F.filter(F.split(part(4), "&"), lambda p: p != ""), pair), lambda p: ~tracking(p["folded"]))
    query = F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(encoded(p["key"]), F.lit("="), encoded(p["value"]))), "&")
    url = F.concat(scheme, F.lit("://"), place, tidy, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme.isin("http", "https") & (name != ""), url).otherwise("")


def emails(value: Column) -> Column:
    """the addresses in a text, in order."""
    return F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(f"({EMAIL})"), 1)


#: F20, fixed values
PLACEHOLDER_DOMAINS = ("example.com", "example.org", "example.net", "domain.com", "email.com")
PLACEHOLDER_LOCALS = ("example", "test", "user", "username", "name", "yourname", "email", "john.doe")
ASSET_EXTENSIONS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js")


def valid_email(address: Column) -> Column:
    """a whole address, not a placeholder, not an asset's name."""
    text = F.trim(address)
    name, place = F.lower(F.regexp_extract(text, r"^(.*)@", 1)), F.regexp_replace(F.lower(F.regexp_extract(text, r"@([^@]*)$", 1)), r"\.+$", "")
    whole = F.rlike(text, F.lit(f"^{EMAIL}$"))
    return whole & ~place.isin(*PLACEHOLDER_DOMAINS) & ~name.isin(*PLACEHOLDER_LOCALS) & ~F.regexp_extract(place, r"([^.]*)$", 1).isin(*ASSET_EXTENSIONS)


def email_status(address: Column, web_domain: Column) -> Column:
    """MATCH, NO_WEBSITE or REVIEW."""
    place = F.lower(F.regexp_extract(address, r"@([^@]*)$", 1))
    match = (place == web_domain) | F.endswith(place, F.concat(F.lit("."), web_domain)) | F.endswith(web_domain, F.concat(F.lit("."), place))
    return F.when(F.coalesce(web_domain, F.lit("")) == "", "NO_WEBSITE").when(match, "MATCH").otherwise("REVIEW")


def safe_token(value: Column) -> Column:
    """F41."""
    return F.regexp_replace(value, r"(?U)[^\w-]", "_")


def attempts(value: Column) -> Column:
    """a whole number of at least 0; 0 for anything else."""
    return F.greatest(F.lit(0), F.coalesce(value.try_cast("int"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """of two arrays as sets; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def trimmed(text: Column, most: int) -> Column:
    """cut at the last word's end within most characters."""
    cut = F.regexp_replace(F.substring(text, 1, most + 1), r"\s+\S*\z", "")
    return F.when(F.length(text) <= most, text).when(F.length(cut) > most, F.substring(text, 1, most)).otherwise(cut)


def has_offset(value: Column) -> Column:
    """the text of a time names its offset from UTC."""
    return F.rlike(F.coalesce(value, F.lit("")), F.lit(r"(?:[Zz]|[+-]\d{2}:?\d{2})\z"))


def age_verdict(when: Column, now: Column) -> Column:
    """F32: by whole days: PASS to 14, NONE to 30, REVIEW to 60 and in the future, REJECT beyond."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(when)) / 86400)
    return F.when(days.isNull(), "UNKNOWN").when(days < 0, "REVIEW").when(days <= 14, "PASS").when(days <= 30, "NONE").when(days <= 60, "REVIEW").otherwise("REJECT")


def error_kind(message: Column) -> Column:
    """kind of a network error by its message."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *words: F.rlike(text, F.lit("|".join(words)))
    return F.when(has("timed out", "timeout"), "TIMEOUT").when(has("name resolution", "getaddrinfo", "dns"), "DNS").when(has("ssl", "certificate"), "TLS").when(has("refused", "reset", "unreachable"), "CONNECTION").when(F.regexp_extract(text, r"(\d{3})", 1) != "", F.concat(F.lit("HTTP_"), F.regexp_extract(text, r"(\d{3})", 1)))
