"""Row rules on single fields and on evidence: e-mail, titles, addresses, people, location statements, repairs, outreach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import job_values as V
from . import places as P
from . import text as T
from .ids import content_hash
from .rules import found, technologies

# Endings of company names that say what kind of company it is.
LEGAL_FORMS = "(?:sa|ltd|llc|inc|gmbh|sarl|sas)"


def company_identity(name: Column) -> Column:
    """letters of a company's name without accents and legal forms at its end."""
    plain = P.folded(F.regexp_replace(name, r"\.", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, rf"( {LEGAL_FORMS})+$", ""), f"^{LEGAL_FORMS}$", ""), " ", "")


# Seniorities that a query asks for, the first that fits.
QUERY_SENIORITY = {"INTERNSHIP": r"\bintern(?:ship)?\b", "ENTRY_LEVEL": r"\bentry[ -]?level\b|\bgraduate\b", "JUNIOR": r"\bjunior\b|\bjr\.?\b"}


def query_dimensions(query: Column) -> Column:
    """seniority and technologies of a query, as a struct."""
    level = F.lit("UNSPECIFIED")
    for name, pattern in reversed(QUERY_SENIORITY.items()):
        level = F.when(found(query, pattern), name).otherwise(level)
    return F.struct(level.alias("seniority"), technologies(query).alias("technologies"))


# Local parts by what they say.
EMAIL_UNAVAILABLE = ("", "n/a", "none", "null", "not available", "unknown")
BUSINESS_LOCALS = ("info", "contact", "hello", "jobs", "careers", "hr", "support", "sales", "commercial", "recruitment", "recruiting")
AUTOMATED_LOCALS = ("noreply", "donotreply", "mailerdaemon")
TELEMETRY = r"(?:^|\.)sentry\."


def email_verdict(address: Column) -> Column:
    """verdict (ACCEPT, REVIEW, REJECT) and reason of one address, as a struct."""
    text = F.trim(F.coalesce(address, F.lit("")))
    low = F.lower(text)
    local, place = F.regexp_extract(low, "^(.*)@", 1), F.regexp_extract(low, "@([^@]*)$", 1)
    compact = F.regexp_replace(local, "[._-]", "")
    told = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))
    return (
        F.when(low.isin(*EMAIL_UNAVAILABLE), told("REJECT", "empty_or_unavailable"))
        .when(F.length(text) > 254, told("REJECT", "address_too_long"))
        .when(~F.rlike(text, F.lit(f"^{T.EMAIL}$")) | (F.length(local) > 64) | F.contains(low, F.lit("..")) | F.rlike(local, F.lit(r"^\.|\.$")), told("REJECT", "malformed_address"))
        .when(place.isin(*T.PLACEHOLDER_DOMAINS) | local.isin(*T.PLACEHOLDER_LOCALS), told("REJECT", "placeholder_address"))
        .when(F.regexp_extract(place, r"([^.]*)$", 1).isin(*T.ASSET_EXTENSIONS), told("REJECT", "asset_address"))
        .when(compact.isin(*AUTOMATED_LOCALS), told("REJECT", "automated_sender"))
        .when((compact == "sentry") | F.rlike(place, F.lit(TELEMETRY)), told("REJECT", "telemetry_address"))
        .when(local.isin(*BUSINESS_LOCALS), told("ACCEPT", "business_role_address"))
        .otherwise(told("REVIEW", "uncertain_local_part"))
    )


#: F23, fixed values: local parts from the most wanted on, and hosts of free mail
LOCAL_PRIORITY = ("contact", "info", "hello", "commercial", "sales", "support", "jobs", "careers", "hr", "recruitment", "recruiting")
FREE_HOSTS = ("gmail.com", "outlook.com", "hotmail.com", "yahoo.com")


def primary_emails(found_emails: Column, web_domain: Column) -> Column:
    """of an array of addresses the valid ones once each (in the first spelling), ranked: those that match the website, then by local part, free
    mail last, then by name: struct of primary, alternates and status."""
    kept = F.filter(found_emails, T.valid_email)
    once = F.filter(kept, lambda e, i: F.array_position(F.transform(kept, F.lower), F.lower(e)) == i + 1)
    rank = lambda e: F.when(F.lower(F.regexp_extract(e, "@(.*)$", 1)).isin(*FREE_HOSTS), 99).otherwise(
        F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LOCAL_PRIORITY)), F.lower(F.regexp_extract(e, "^(.*)@", 1))), F.lit(0)), F.lit(98))
    )
    status = lambda e: F.when(T.email_status(e, web_domain) == "MATCH", 0).when(T.email_status(e, web_domain) == "NO_WEBSITE", 1).otherwise(2)
    ranked = F.transform(F.array_sort(F.transform(once, lambda e: F.struct(status(e).alias("s"), rank(e).cast("bigint").alias("r"), F.lower(e).alias("l"), e.alias("e")))), lambda x: x["e"])
    first = F.get(ranked, F.lit(0))
    return F.struct(F.coalesce(first, F.lit("")).alias("primary"), F.array_join(F.slice(ranked, 2, 100_000), ";").alias("alternates"), F.when(first.isNull(), "").otherwise(T.email_status(first, web_domain)).alias("status"))


def address_country(address: Column) -> Column:
    """the country that the right-most part of an address names."""
    return F.coalesce(F.get(F.filter(F.transform(F.reverse(F.split(address, ",")), P.lead_country), lambda c: c != ""), F.lit(0)), F.lit(""))


def usable_time(value: Column) -> Column:
    """a time that names its offset."""
    return T.has_offset(value) & F.try_to_timestamp(value).isNotNull()


# Words of pages that are no posting, and whole titles of such.
PAGE_WORDS = r"\b(?:cookies?|privacy|policy|terms|login|sign in)\b"
PAGE_TITLES = ("careers", "jobs", "home", "vacancies")


def safe_title(title: Column) -> Column:
    """a title that may be a posting's."""
    return ~found(title, PAGE_WORDS) & ~F.lower(F.trim(title)).isin(*PAGE_TITLES) & (F.trim(title) != "")


def safe_place(value: Column) -> Column:
    """a location, city or region that may be one: short, with letters, without address or mark-up signs."""
    text = T.text_value(value)
    return (text != "") & (F.length(text) <= 80) & F.rlike(text, F.lit(r"(?U)\p{Alpha}")) & ~F.rlike(text, F.lit(r"[<>{}@]|https?:"))


def title_from_url(url: Column) -> Column:
    """the title that the last words of a path spell."""
    return F.initcap(F.replace(F.regexp_extract(url, r"/([a-z]+(?:-[a-z]+)+)(?:-\d+)?/?$", 1), F.lit("-"), F.lit(" ")))


def config_hash(*parts: Column) -> Column:
    """F39."""
    return content_hash(F.concat_ws("|", *parts))


def company_domain(text: Column) -> Column:
    """the one host of all addresses in a text that is not free mail; '' if there is none or are several."""
    hosts = F.array_distinct(F.filter(F.transform(T.emails(text), lambda e: F.lower(F.regexp_extract(e, "@(.*)$", 1))), lambda d: ~d.isin(*FREE_HOSTS)))
    return F.transform(F.array(hosts), lambda d: F.when(F.size(d) == 1, F.get(d, F.lit(0))).otherwise(""))[0]


def google_host(url: Column) -> Column:
    """F45."""
    return F.rlike(T.host(url), F.lit(r"(^|\.)google\.[a-z.]+$"))


def result_evidence(email: Column, result_url: Column, site: Column, title_match: Column, contact_page: Column) -> Column:
    """An address found by search counts if its host is that of the site, or if the result is on the site and its title fits or it is a contact page."""
    on_site = T.domain_matches(T.domain(result_url), site)
    return (site != "") & ((T.email_status(email, site) == "MATCH") | (on_site & (title_match | contact_page)))


def enrichment_status(rows: DataFrame) -> DataFrame:
    """Website, description, industry, source_context, useful (any field was found), failed, attempts (text): status by how complete a lead is."""
    has = lambda c: T.clean(F.col(c)) != ""
    status = (
        F.when(T.domain(F.col("website")) == "", "NO_WEBSITE")
        .when(has("description") & has("industry") & has("source_context"), "SUCCESS")
        .when(F.col("useful") | has("description") | has("industry"), "PARTIAL")
        .when(F.col("failed"), "FAILED")
        .when(T.attempts(F.col("attempts")) == 0, "PENDING")
        .otherwise("INCOMPLETE")
    )
    return rows.withColumn("enrichment_status", status)


# States of outreach.
SEND_STATUSES = ("PENDING", "FAILED", "SENT")


def outreach_history(history: DataFrame, marks: DataFrame) -> DataFrame:
    """History (domain, send_status, sent_at) with marks (domain, mark: SENT or FAILED, at): canonical states; what was sent once stays sent, at its first time."""
    sent = lambda c: F.upper(T.text_value(F.col(c)))
    own = history.select(T.domain(F.col("domain")).alias("domain"), F.when(sent("send_status").isin(*SEND_STATUSES), sent("send_status")).otherwise("PENDING").alias("s"), F.col("sent_at").alias("t"), F.lit(0).alias("o"))
    new = marks.select(T.domain(F.col("domain")).alias("domain"), sent("mark").alias("s"), F.col("at").alias("t"), F.lit(1).alias("o"))
    rank = F.when(F.col("s") == "SENT", 2).when(F.col("s") == "FAILED", 1).otherwise(0)
    both = own.unionByName(new).where("domain <> ''")
    return both.groupBy("domain").agg(F.max_by("s", rank).alias("send_status"), F.min_by(F.when(F.col("s") == "SENT", F.col("t")), F.when(F.col("s") == "SENT", F.struct("o", "t"))).alias("sent_at"))


def repair_method(source: Column) -> Column:
    """How a field was repaired, by its source."""
    out = F.lit("UNKNOWN")
    for name, method in reversed(V.REPAIR_METHODS):
        out = F.when(F.startswith(source, F.lit(name[:-1])) if name.endswith("*") else source == name, method).otherwise(out)
    return out


def repairs(rows: DataFrame, fields: dict[str, object]) -> DataFrame:
    """Rows with the stored values, new_<field> and source_<field>: fixes, a map of field to (old, new, source, method), and status.

    A field is filled if it is blank or demonstrably invalid and the new value is valid and another one. An invalid value without a valid new one is cleared.
    fields: name to a function that tells valid values.
    """
    entries = []
    for name, valid in fields.items():
        old, new, source = T.text_value(F.col(name)), T.text_value(F.col(f"new_{name}")), F.coalesce(F.nullif(T.text_value(F.col(f"source_{name}")), F.lit("")), F.lit("UNKNOWN"))
        broken, good = (old != "") & ~valid(old), (new != "") & valid(new)
        fix = lambda value, origin: F.struct(F.lit(name).alias("key"), F.struct(old.alias("old_value"), value.alias("new_value"), origin.alias("source"), repair_method(origin).alias("method")).alias("value"))  # noqa: B023, E731
        entries.append(F.when(((old == "") | broken) & good & (old != new), fix(new, source)).when(broken, fix(F.lit(""), F.lit("DETERMINISTIC_VALIDATION"))))
    fixes = F.map_from_entries(F.array_compact(F.array(*entries)))
    missing = sum(F.when(T.text_value(F.col(n)) == "", 1).otherwise(0) for n in fields)
    filled = F.size(F.filter(F.map_values(fixes), lambda x: x["new_value"] != ""))
    status = F.when(F.size(fixes) == 0, "NO_CHANGE").when(filled >= missing, "SUCCESS").otherwise("PARTIAL")
    return rows.withColumn("fixes", fixes).withColumn("repair_status", status)


def repair_cleanup(rows: DataFrame, results: DataFrame, key: str, fields: dict[str, object]) -> DataFrame:
    """Values that a repair filled and that are not valid now are cleared; others stay. results: key, at, filled (map of field to source), newest first
    for each field. Column cleared: map of the fields cleared to (value, source)."""
    told = results.select(key, "at", F.explode("filled").alias("field", "source")).groupBy(key, "field").agg(F.max_by("source", "at").alias("source"))
    sources = told.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", "source"))).alias("_sources"))  # a few fields
    joined = rows.join(sources, key, "left")
    source = lambda n: F.try_element_at("_sources", F.lit(n))
    bad = {n: source(n).isNotNull() & (T.text_value(F.col(n)) != "") & ~valid(T.text_value(F.col(n))) for n, valid in fields.items()}
    entries = [F.when(F.coalesce(b, F.lit(False)), F.struct(F.lit(n).alias("key"), F.struct(F.col(n).alias("value"), source(n).alias("source")).alias("value"))) for n, b in bad.items()]
    cleared = joined.withColumn("cleared", F.map_from_entries(F.array_compact(F.array(*entries))))
    return cleared.select(*[F.when(F.array_contains(F.map_keys("cleared"), c), None).otherwise(F.col(c)).alias(c) if c in fields else c for c in rows.columns], "cleared")


def sentences(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.filter(F.transform(F.split(plain, r"(?<=[.!?])\s+|\s*[|•]\s*"), F.trim), lambda s: s != "")


def _country(text: Column) -> Column:
    return F.transform(F.array(P.job_country(text, False)), lambda c: F.when(c != "", c).when(F.rlike(text, F.lit(r"\b(?:UK|U\.K\.)\b")), "United Kingdom").otherwise(""))[0]


#: cities that a statement can name
CITIES = ("London", "Lisbon", "Paris", "Tunis", "Amsterdam", "Brussels")


def _city(text: Column) -> Column:
    return F.coalesce(*[F.when(found(text, rf"\b{c}\b"), c) for c in CITIES], F.lit(""))


def _jurisdiction(text: Column) -> Column:
    """The first of country, region and city that a sentence names."""
    region = F.coalesce(*[F.when(found(text, p), n) for n, p in V.JURISDICTIONS.items()], F.lit(""))
    country = _country(text)
    return F.struct(country.alias("country"), F.when(country == "", region).otherwise("").alias("region"), F.when((country == "") & (region == ""), _city(text)).otherwise("").alias("city"))


def location_eligibility(rows: DataFrame) -> DataFrame:
    """Description, location_text, country, region, city, remote_policy: what a posting says, sentence by sentence, on where its work is done.

    work_model, remote_scope, required_country, required_region, required_city, residency, authorization, jurisdiction, visa, relocation, and eligibility:
    KNOWN if that settles the place, PARTIAL if statements conflict or settle nothing, UNKNOWN without any.
    """
    base = rows.withColumn("_s", sentences(F.col("description"))).withColumn("_policy", F.upper(T.text_value(F.col("remote_policy"))))
    remote = lambda s: (found(s, V.REMOTE_WORK) | found(s, V.BARE_REMOTE)) & ~found(s, V.FALSE_REMOTE) & ~found(s, V.NOT_THIS_ROLE) & ~found(s, V.REMOTE_TEAM)
    some = lambda pattern, but=None: F.exists("_s", lambda s: found(s, pattern) & (~found(s, but) if but else F.lit(True)))
    model = lambda name, said: F.when((F.col("_policy") == name) | said, F.lit(name))
    base = base.withColumn("_remote", F.filter("_s", remote)).withColumn(
        "_models", F.array_compact(F.array(model("ONSITE", some(V.ONSITE_WORK, V.HYBRID_WORK)), model("HYBRID", some(V.HYBRID_WORK)), model("REMOTE", F.size("_remote") > 0)))
    )
    scope = lambda s: F.coalesce(*[F.when(found(s, p), n) for n, p in V.SCOPES.items()], F.when(_country(s) != "", "COUNTRY"), F.when((_city(s) != "") & found(s, r"within\s+\d+\s+hours?\s+of"), "CITY"))
    base = base.withColumn("_scopes", F.array_distinct(F.array_compact(F.transform("_remote", scope))))
    only = lambda c: F.when(F.size(c) == 1, F.get(c, F.lit(0)))
    base = base.withColumn("work_model", F.coalesce(only("_models"), F.lit("UNKNOWN"))).withColumn("remote_scope", F.coalesce(only("_scopes"), F.lit("UNKNOWN")))
    base = base.withColumn("_home", F.transform(F.filter("_s", lambda s: found(s, V.RESIDENCY)), _jurisdiction)).withColumn("_permit", F.transform(F.filter("_s", lambda s: found(s, V.WORK_PERMIT)), _jurisdiction))
    office = F.col("work_model").isin("ONSITE", "HYBRID")
    named = lambda part: F.transform("_home", lambda j: j[part])
    stated = lambda name: T.text_value(F.col(name))
    where = F.transform(F.array(F.concat_ws(" ", stated("country"), stated("location_text"))), lambda c: P.job_country(c, True))
    scoped = lambda values, *names: F.when(F.col("remote_scope").isin(*names), values).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    values = {
        "country": F.concat(named("country"), F.when(office, where).otherwise(none), scoped(F.transform("_remote", _country), "COUNTRY")),
        "region": F.concat(named("region"), F.when(office, F.array(stated("region"))).otherwise(none), scoped(F.array("remote_scope"), "EUROPE", "EU", "EEA")),
        "city": F.concat(named("city"), F.when(office, F.array(F.coalesce(F.nullif(stated("city"), F.lit("")), _city(F.col("location_text")), F.lit("")))).otherwise(none), scoped(F.transform("_remote", _city), "CITY")),
    }
    for part, every in values.items():
        base = base.withColumn(f"_{part}", F.array_distinct(F.filter(every, lambda v: F.coalesce(v, F.lit("")) != "")))
    base = base.withColumn("_law", F.array_distinct(F.filter(F.transform("_permit", lambda j: F.coalesce(F.nullif(j["country"], F.lit("")), F.nullif(j["region"], F.lit("")), j["city"])), lambda v: v != "")))
    polarity = lambda yes, no: F.when(yes & no, "UNKNOWN").when(yes, "AVAILABLE").when(no, "NOT_AVAILABLE").otherwise("NOT_STATED")
    required = lambda c: F.when(F.size(c) > 0, "REQUIRED").otherwise("NOT_STATED")
    told = base.withColumns({
        **{f"required_{p}": F.coalesce(only(f"_{p}"), F.lit("")) for p in values},
        "residency": required("_home"), "authorization": required("_permit"), "jurisdiction": F.coalesce(only("_law"), F.lit("")),
        "visa": polarity(some(V.VISA_YES, V.VISA_NO), some(V.VISA_NO)), "relocation": polarity(some(V.MOVE_YES, V.MOVE_NO), some(V.MOVE_NO)),
    })
    conflict = (F.size("_models") > 1) | (F.size("_scopes") > 1) | (F.size("_law") > 1) | (F.col("visa") == "UNKNOWN") | (F.col("relocation") == "UNKNOWN")
    for part in values:
        conflict = conflict | (F.size(f"_{part}") > 1)
    place = (F.col("required_country") != "") | (F.col("required_region") != "") | (F.col("required_city") != "")
    settled = (office & place) | ((F.col("work_model") == "REMOTE") & (F.col("remote_scope") != "UNKNOWN")) | ((F.col("residency") == "REQUIRED") & place) | ((F.col("authorization") == "REQUIRED") & (F.col("jurisdiction") != ""))
    anything = (F.size("_models") > 0) | (F.col("residency") == "REQUIRED") | (F.col("authorization") == "REQUIRED") | (F.col("visa") != "NOT_STATED") | (F.col("relocation") != "NOT_STATED")
    out = told.withColumn("eligibility", F.when(conflict | (anything & ~settled), "PARTIAL").when(settled, "KNOWN").otherwise("UNKNOWN"))
    return out.drop("_s", "_policy", "_remote", "_models", "_scopes", "_home", "_permit", "_law", *[f"_{p}" for p in values])


# Roles of people who hire, and words of people who left or only handle staff.
PERSON_ROLES = {"RECRUITER": r"\brecruiter\b|\btalent\b", "ENGINEERING_MANAGER": r"\bengineering manager\b", "TECH_LEADER": r"\b(?:cto|vp engineering|head of engineering)\b"}
FORMER = r"\b(?:former|ex|previously)\b"


def person_evaluation(rows: DataFrame) -> DataFrame:
    """Title, company, target_company, snippet, source_type, explicit (named in the posting), region_match: status, confidence and reasons of a person."""
    role = F.coalesce(*[F.when(found(F.col("title"), p), n) for n, p in PERSON_ROLES.items()], F.lit(""))
    same = (company_identity(F.col("company")) != "") & (company_identity(F.col("company")) == company_identity(F.col("target_company")))
    named = F.col("explicit") & same
    former = found(F.concat_ws(" ", "title", "company", "snippet"), FORMER)
    status = F.when(former, "REJECTED_FORMER_EMPLOYEE").when(~same, "REJECTED_COMPANY_MISMATCH").when((role == "") & ~named, "REJECTED_ROLE_MISMATCH").otherwise("CANDIDATE")
    good = status == "CANDIDATE"
    confidence = F.when(~good, "LOW").when(named | (F.col("source_type") == "OFFICIAL_COMPANY") | F.col("region_match"), "HIGH").otherwise("MEDIUM")
    relation = F.when(~good, "NONE").when(named, "EXPLICIT_JOB_CONTACT").when(F.col("source_type") == "OFFICIAL_COMPANY", "OFFICIAL_COMPANY_ROLE").when(F.col("region_match"), "REGION_ALIGNED_HIRING_ROLE").otherwise("COMPANY_HIRING_ROLE")
    return rows.withColumns({"role": F.when(named, "EXPLICIT_CONTACT").otherwise(role), "person_status": status, "confidence": confidence, "relationship": relation})


def application_destination(candidates: DataFrame, key: str) -> DataFrame:
    """Candidates (key, url, rank, fetched, accepted): the best-ranked accepted address; CONFLICT if several tie, UNAVAILABLE if none that was there could be read."""
    best = candidates.where("accepted").groupBy(key, "rank").agg(F.min("url").alias("_least"), F.max("url").alias("_most")).groupBy(key).agg(F.min_by(F.struct("_least", "_most"), "rank").alias("_best"))
    seen = candidates.groupBy(key).agg(F.bool_and(~F.col("fetched")).alias("_unread"))
    status = F.when(F.col("_best._least") == F.col("_best._most"), "CONFIRMED").when(F.col("_best").isNotNull(), "CONFLICT").when(F.col("_unread"), "UNAVAILABLE").otherwise("UNKNOWN")
    return seen.join(best, key, "left").select(key, status.alias("status"), F.when(status == "CONFIRMED", F.col("_best._least")).otherwise("").alias("url"))


def company_website(evidence: DataFrame, key: str) -> DataFrame:
    """Evidence (key, url): CONFIRMED if all trustworthy hosts have one registrable domain, CONFLICT if not, UNKNOWN without any."""
    place = T.registrable_domain(T.domain(F.col("url")))
    trusted = evidence.select(key, F.when(T.trustworthy_domain(place), place).alias("_d"))
    found_ = trusted.groupBy(key).agg(F.min("_d").alias("_least"), F.max("_d").alias("_most"))
    status = F.when(F.col("_least").isNull(), "UNKNOWN").when(F.col("_least") == F.col("_most"), "CONFIRMED").otherwise("CONFLICT")
    return found_.select(key, status.alias("status"), F.when(status == "CONFIRMED", F.col("_least")).otherwise("").alias("domain"))


#: H7, fixed values: a name in prose, and the statements that name a client or an employer
NAME = r"[A-ZÀ-ÖØ-Þ][\wÀ-ÖØ-öø-ÿ&.'’+-]*(?:\s+[A-ZÀ-ÖØ-Þ][\wÀ-ÖØ-öø-ÿ&.'’+-]*){0,5}"
CLIENT = rf"\b(?:(?i:our client|on behalf of|we are hiring for|hiring for))\s*[:,-]?\s*({NAME})(?=\s*(?:,|\.|;|who\b|is\b|are\b|seeks?\b|has\b))"
CLIENT_FRENCH = rf"\b(?:(?i:notre client|pour le compte de))\s*[:,-]?\s*({NAME})(?=\s*(?:,|\.|;|qui\b|est\b|recherche\b))"
EMPLOYER = rf"\b({NAME})\s+(?:is|est)\s+(?:an?|une?)\s+(?:international\s+)?(?:company|employer|soci[ée]t[ée]|entreprise|éditeur)\b"
NOBODY = ("partner", "partner company", "hiring company", "company", "client")


def employer_statements(description: Column, company: Column) -> Column:
    """H7: what a posting's prose says of the employer: an ordered array of (value, method), each value and method once."""
    text = F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " "))
    quoted = F.concat(F.lit(r"\Q"), F.replace(company, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))
    own = F.concat(F.lit(r"(?iU)\b(?:join|joining|rejoignez|chez|at|about)\s+"), quoted, F.lit(r"\b|\b"), quoted, F.lit(r"\s+(?:is|est)\s+(?:an?|une?)\s+(?:company|employer|soci[ée]t[ée]|entreprise|éditeur)\b|\b"), quoted, F.lit(r"\s+is an equal opportunity employer\b"))
    stated = lambda value, method: F.struct(value.alias("value"), F.lit(method).alias("method"))
    every = lambda pattern, method: F.transform(F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), 1), lambda v: stated(F.regexp_replace(F.trim(v), r"[.]$", ""), method))
    said = F.when((T.text_value(company) != "") & F.rlike(text, own), F.array(stated(company, "EXPLICIT_JOB_EMPLOYER_STATEMENT"))).otherwise(F.array().cast("array<struct<value:string,method:string>>"))
    facts = F.concat(said, every(CLIENT, "EXPLICIT_RECRUITER_CLIENT"), every(CLIENT_FRENCH, "EXPLICIT_RECRUITER_CLIENT"), every(EMPLOYER, "EXPLICIT_JOB_EMPLOYER_STATEMENT"))
    return F.array_distinct(F.filter(facts, lambda f: ~F.lower(f["value"]).isin(*NOBODY)))
