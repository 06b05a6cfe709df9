"""Registered queries of landed sources, of text functions and of single rules, with their SQL.

Landed answers are built from the test tables as JSON, read by the sources' own parsers, and held against SQL over the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import config as C
from .catalogue import _html_sql, query, ts
from .catalogue_reads import _events, pick_of
from .functions import email, markup, rules, text, url
from .operators import details
from .operators.graph import new_folder
from .plans import bindings as B
from .plans.oracle import case
from .sources import format as landed_as_format
from .sources import landed


#: Events whose items may share one answer: sources give their answers in pages of a bounded size.
PAGE = 50_000


def _landed(rows, by, item, wrap: str | None, whole: bool = False):
    """Answers for each value of ``by``, one for each PAGE of events (``whole``: one for all): a JSON object with the items in a list named ``wrap``, or the bare list;
    and one that is no JSON."""
    page = F.lit(0) if whole else F.floor(F.col("event_id") / PAGE)
    g = rows.groupBy(by.alias("g"), page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("event_id", item.alias("x")))).alias("l"))
    items = F.transform("l", lambda v: v["x"])
    body = F.to_json(F.struct(items.alias(wrap)) if wrap else items)
    out = g.select(F.concat(F.lit("g"), F.col("g").cast("string")).alias("board"), body.alias("body"))
    return out.unionByName(rows.sparkSession.createDataFrame([("junk", "<html>no answer</html>")], "board string, body string"))


def _seconds(c):
    return F.timestamp_diff("SECOND", ts("1970-01-01 00:00:00"), F.col(c))


def _epoch(c):
    return F.unix_seconds(F.col(c)).alias("seconds")


_s = lambda c: c.cast("string")
_FLOOR = "CAST(floor(epoch_us(ts) / 1e6) AS BIGINT)"


@query(f"SELECT 'stories' AS engine, event_type AS title, 'https://u' || user_id || '.io/' || event_id AS url, 'a' || user_id AS author, {_FLOOR} AS seconds, 'v & ' || event_id AS snippet FROM events")
def landed_stories(s, d):
    i, u = F.col("event_id"), F.col("user_id")
    item = F.struct(F.col("event_type").alias("title"), F.concat(F.lit("https://u"), _s(u), F.lit(".io/"), _s(i)).alias("url"),
        F.concat(F.lit("a"), _s(u)).alias("author"), _seconds("ts").alias("created_at_i"), F.concat(F.lit("<p>v &amp; "), _s(i), F.lit("</p>")).alias("story_text"))
    return landed.stories(_landed(_events(s, d), u % 50, item, "hits")).select("engine", "title", "url", "author", _epoch("published_at"), "snippet")


@query(f"SELECT 'stories' AS engine, event_type AS title, 'https://u' || user_id || '.io/' || event_id AS url, 'a' || user_id AS author, {_FLOOR} AS seconds, 'v & ' || event_id AS snippet FROM events")
def landed_format(s, d):
    """The same through the format: bodies written as lines, read back in ranges of bytes."""
    i, u = F.col("event_id"), F.col("user_id")
    item = F.struct(F.col("event_type").alias("title"), F.concat(F.lit("https://u"), _s(u), F.lit(".io/"), _s(i)).alias("url"),
        F.concat(F.lit("a"), _s(u)).alias("author"), _seconds("ts").alias("created_at_i"), F.concat(F.lit("<p>v &amp; "), _s(i), F.lit("</p>")).alias("story_text"))
    folder = new_folder(s, "landed")
    _landed(_events(s, d), u % 50, item, "hits").select("body").write.text(folder)
    landed_as_format.register(s)
    rows = s.read.format("landed").option("range", str(1 << 16)).load(folder)
    return landed.stories(rows).select("engine", "title", "url", "author", _epoch("published_at"), "snippet")


@query(f"""SELECT title, url, author, seconds, snippet FROM (SELECT *, row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id) AS r
    FROM (SELECT event_id, 'a' || user_id AS author, {_FLOOR} AS seconds,
  CASE event_id % 3 WHEN 0 THEN 'Acme' || event_id ELSE 'Plain Co ' || event_id END AS title, CASE event_id % 3
  WHEN 0 THEN 'https://acme' || event_id || '.io/jobs' ELSE 'https://www.plain' || event_id || '.com/x' END AS url,
  CASE event_id % 3 WHEN 0 THEN 'Acme' || event_id || ' | Dhaka | apply' ELSE 'Plain Co ' || event_id || ' - hiring https://www.plain' || event_id || '.com/x, now' END AS snippet FROM events WHERE event_id % 3 <> 1)) WHERE r <= 5""")
def landed_threads(s, d):
    """Comments of threads that name a company's address, the first five of a thread."""
    i = F.col("event_id")
    said = F.when(i % 3 == 0, F.concat(F.lit("Acme"), _s(i), F.lit(' | Dhaka | <a href="https:&#x2F;&#x2F;acme'), _s(i),
        F.lit('.io&#x2F;jobs">apply</a>'))).when(i % 3 == 1, "see https://github.com/x only")
    said = said.otherwise(F.concat(F.lit("Plain Co "), _s(i), F.lit(" - hiring https://www.plain"), _s(i), F.lit(".com/x, now")))
    item = F.struct(said.alias("comment_text"), F.concat(F.lit("a"), _s(F.col("user_id"))).alias("author"), _seconds("ts").alias("created_at_i"))
    return landed.thread_comments(_landed(_events(s, d), i % 500, item, "hits", whole=True), 5).select("title", "url", "author", _epoch("published_at"), "snippet")


@query(f"SELECT 'o' || user_id || '/r' || event_id AS title, 'https://github.com/r' || event_id AS url, CASE WHEN event_id % 2 = 0 THEN 'https://r' || event_id || '.io' END AS homepage, 'o' || user_id AS author, {_FLOOR} AS seconds, event_type AS snippet FROM events WHERE user_id % 3 < 2")
def landed_repositories(s, d):
    """Repositories of organizations; those of persons are left out."""
    i, u = F.col("event_id"), F.col("user_id")
    owner = F.struct(F.concat(F.lit("o"), _s(u)).alias("login"), F.when(u % 3 < 2, "Organization").otherwise("User").alias("type"))
    item = F.struct(F.concat(F.lit("o"), _s(u), F.lit("/r"), _s(i)).alias("full_name"), F.concat(F.lit("https://github.com/r"), _s(i)).alias("html_url"),
        F.when(i % 2 == 0, F.concat(F.lit("https://r"), _s(i), F.lit(".io"))).alias("homepage"),
                    F.col("event_type").alias("description"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("pushed_at"), owner.alias("owner"))
    return landed.repositories(_landed(_events(s, d), u % 50, item, "items")).select("title", "url", "homepage", "author", _epoch("published_at"), "snippet")


@query("SELECT 'web' AS engine, event_type AS title, 'https://w' || event_id || '.io/' AS url, 's' || event_id AS snippet FROM events WHERE event_id % 10 <> 3")
def landed_web(s, d):
    """Organic and news results; an answer with an error gives none."""
    i = F.col("event_id")
    item = F.array(F.struct(F.col("event_type").alias("title"), F.concat(F.lit("https://w"), _s(i), F.lit(".io/")).alias("link"),
        F.concat(F.lit("s"), _s(i)).alias("snippet")))
    none = F.lit(None).cast(item_type(s, d, item))
    body = F.struct(F.when(i % 10 == 3, "quota").alias("error"), F.when(i % 2 == 0, item).otherwise(none).alias("organic_results"),
        F.when(i % 2 == 1, item).otherwise(none).alias("news_results"))
    return landed.web_results(_events(s, d).select(F.to_json(body).alias("body")))


def item_type(s, d, column):
    return _events(s, d).select(column.alias("c")).schema["c"].dataType


@query(f"SELECT 'g' || user_id % 50 AS board, event_type AS title, 'https://b/' || event_id AS url, {_FLOOR} AS seconds, 'need & ' || event_id AS content FROM events")
def landed_board_a(s, d):
    i = F.col("event_id")
    item = F.struct(F.col("event_type").alias("title"), F.concat(F.lit("https://b/"), _s(i)).alias("absolute_url"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"), F.concat(F.lit("<p>need &amp;amp; "), _s(i), F.lit("</p>")).alias("content"))
    out = landed.greenhouse(_landed(_events(s, d), F.col("user_id") % 50, item, "jobs"))
    return out.select("board", "title", "url", _epoch("published_at"), F.replace("content", F.lit("&amp;"), F.lit("&")).alias("content"))


@query("SELECT 'g' || user_id % 50 AS board, event_type AS title, 'https://b/' || event_id AS url, CASE WHEN event_id % 5 > 0 THEN CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) END AS seconds, 'plain ' || event_id AS content FROM events")
def landed_board_b(s, d):
    """Times in milliseconds, some of them no number."""
    i = F.col("event_id")
    at = F.when(i % 5 > 0, _s(F.timestamp_diff("MILLISECOND", ts("1970-01-01 00:00:00"), F.col("ts")))).otherwise("soon")
    item = F.struct(F.col("event_type").alias("text"), F.concat(F.lit("https://b/"), _s(i)).alias("hostedUrl"), at.alias("createdAt"),
        F.concat(F.lit("plain "), _s(i)).alias("descriptionPlain"))
    return landed.lever(_landed(_events(s, d), F.col("user_id") % 50, item, None)).select("board", "title", "url", _epoch("published_at"), "content")


@query(f"SELECT 'g' || user_id % 50 AS board, event_type AS title, 'https://b/' || event_id AS url, {_FLOOR} AS seconds, 'plain ' || event_id AS content FROM events")
def landed_board_c(s, d):
    i = F.col("event_id")
    item = F.struct(F.col("event_type").alias("title"), F.concat(F.lit("https://b/"), _s(i)).alias("jobUrl"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"), F.concat(F.lit("plain "), _s(i)).alias("descriptionPlain"))
    return landed.ashby(_landed(_events(s, d), F.col("user_id") % 50, item, "jobs")).select("board", "title", "url", _epoch("published_at"), "content")


def _certificates(s, d):
    i, u = F.col("event_id"), F.col("user_id") % 50
    zone = F.concat(F.lit("d"), _s(u), F.lit(".io"))
    names = F.concat(F.lit("*.H"), _s(i % 7), F.lit("."), zone, F.lit("\n"), zone, F.lit("\nother.example"))
    item = F.struct(names.alias("name_value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("not_before"))
    g = _landed(_events(s, d), u, item, None)
    return landed.certificate_names(g.where("board <> 'junk'").select(F.concat(F.lit("d"), F.substring("board", 2, 9), F.lit(".io")).alias("domain"), "body"))


_certs = "(SELECT 'd' || user_id % 50 || '.io' AS domain, CASE WHEN x = 0 THEN 'h' || event_id % 7 || '.' ELSE '' END || 'd' || user_id % 50 || '.io' AS name, ts FROM events, (VALUES (0), (1)) AS v(x))"


@query(f"SELECT domain, name, CAST(floor(epoch_us(min(ts)) / 1e6) AS BIGINT) AS seconds FROM {_certs} GROUP BY domain, name")
def certificate_names(s, d):
    return _certificates(s, d).select("domain", "name", F.unix_seconds("first_issued").alias("seconds"))


@query(f"SELECT domain, count(*) AS subdomains, count(*) FILTER (WHERE last >= TIMESTAMP '2024-01-20') AS growth FROM (SELECT domain, name, max(date_trunc('second', ts)) AS last FROM {_certs} GROUP BY domain, name) GROUP BY domain")
def certificate_growth(s, d):
    return landed.certificate_growth(_certificates(s, d), F.lit("2024-01-20 00:00:00").cast("timestamp"))


@query("""SELECT 'c' || c_custkey || '.io' AS domain, CASE WHEN c_custkey % 4 > 0 THEN CAST(date_diff('day', DATE '2024-01-01' - to_days(CAST(c_custkey % 700 AS INT)),
    DATE '2024-02-01') AS INT) END AS age_days,
  CASE WHEN c_custkey % 3 > 0 THEN 'Names Inc ' || c_custkey END AS registrar FROM customer""")
def registrations(s, d):
    """Registration data: the age, and the registrar's name from its card; events or roles may be missing."""
    k = F.col("c_custkey")
    day = F.date_format(F.date_sub(F.lit("2024-01-01").cast("date"), (k % 700).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'")
    event = F.concat(F.lit('{"eventAction":"last changed","eventDate":"2024-01-15T00:00:00Z"}'),
        F.when(k % 4 > 0, F.concat(F.lit(',{"eventAction":"registration","eventDate":"'), day, F.lit('"}'))).otherwise(""))
    card = F.concat(F.lit('["vcard",[["version",{},"text","4.0"],["fn",{},"text","Names Inc '), _s(k), F.lit('"]]]'))
    role = F.when(k % 3 > 0, '["registrar"]').otherwise('["abuse"]')
    body = F.concat(F.lit('{"events":['), event, F.lit('],"entities":[{"roles":["abuse"]},{"roles":'), role, F.lit(',"vcardArray":'), card, F.lit("}]}"))
    x = B.read(s, d, "customer").select(F.concat(F.lit("c"), _s(k), F.lit(".io")).alias("domain"), body.alias("body"))
    return landed.registration(x, F.lit("2024-02-01").cast("date")).select("domain", F.col("age_days").cast("int").alias("age_days"), "registrar")


@query("""SELECT c_custkey AS k, c_custkey % 2 = 0 AS mx, CASE WHEN c_custkey % 3 = 0 THEN 'v=spf1 -all' END AS spf, CASE
    WHEN c_custkey % 5 = 0 THEN 'reject' END AS dmarc, CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 7 = 1 END AS dnssec FROM customer""")
def dns_answers(s, d):
    """Records of lookups as one row a domain; what was not looked up stays unknown."""
    k = F.col("c_custkey")
    row = lambda kind, value, cond=None: F.when(F.lit(True) if cond is None else cond, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    every = F.array_compact(F.array(
        row("MX", F.when(k % 2 == 0, "mx.example")), row("TXT", F.lit("google=1")), row("TXT", F.when(k % 3 == 0, "v=spf1 -all")),
            row("DMARC", F.when(k % 5 == 0, "v=DMARC1; p=reject").otherwise("v=DMARC1")), row("DNSKEY", F.when(k % 7 == 1, "key"), k % 7 > 0),
    ))
    x = B.read(s, d, "customer").select(F.concat(F.lit("c"), _s(k)).alias("domain"), F.explode(every).alias("r")).select("domain", "r.*")
    return landed.dns_records(x).select(F.substring("domain", 2, 20).cast("long").alias("k"), "hygiene.mx", "hygiene.spf", "hygiene.dmarc", "hygiene.dnssec")


# ------------------------------------------------------------------------------------------------ text


@query(f"SELECT page_id, sha256(replace(replace(body, '&copy;', '©'), '&middot;', '·')) AS sha FROM ({_html_sql()})")
def parsed_prose(s, d):
    """The token parser's prose: on these pages that of the patterns, with all character references decoded."""
    return B.read(s, d, "pages").select("page_id", F.sha2(markup.html_prose("html")["text"], 256).alias("sha"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE rtrim(CASE WHEN strpos(reverse(left(text, 300)), ' ') > 0 AND 300 - strpos(reverse(left(text,
    300)), ' ') > 240 THEN left(text, 300 - strpos(reverse(left(text, 300)), ' ')) ELSE left(text, 300) END, ' ') || ' …' END AS cut FROM documents""")
def prose_budget(s, d):
    return B.read(s, d, "documents").select("doc_id", text.cut_prose(F.col("text"), 300).alias("cut"))


@query(f"SELECT doc_id, sha256('{C.OPEN_FENCE}' || chr(10) || text || ' [REDACTED_DELIMITER]' || chr(10) || '{C.CLOSE_FENCE}') AS sha FROM documents")
def fenced_text(s, d):
    return B.read(s, d, "documents").select("doc_id", F.sha2(text.wrap_untrusted(F.concat("text", F.lit(f" {C.CLOSE_FENCE}"))), 256).alias("sha"))


@query(f"""SELECT event_id, '{C.REDACTED}' AS webhook, '{C.REDACTED}' AS my_token, CASE WHEN event_id % 2 = 0 THEN '{C.REDACTED}'
    ELSE 'plain ' || event_id END AS note FROM events""")
def secret_maps(s, d):
    i = F.col("event_id")
    m = F.create_map(F.lit("Webhook"), F.lit("x"), F.lit("my_token"), F.lit("y"), F.lit("note"),
        F.when(i % 2 == 0, "Bearer abcdefghijklmnop").otherwise(F.concat(F.lit("plain "), _s(i))))
    return _events(s, d).select("event_id", text.scrub_map(m).alias("m")).select("event_id", F.col("m")["Webhook"].alias("webhook"),
        F.col("m")["my_token"].alias("my_token"), F.col("m")["note"].alias("note"))


@query("SELECT page_id, 'sales@p' || page_id || '.io,b@c.io' AS emails FROM pages")
def mailto_addresses(s, d):
    p = F.col("page_id")
    html = F.concat("html", F.lit('<a href="mailto:Sales@p'), _s(p), F.lit('.io?subject=x">m</a> <a href="mailto: b@c.io">n</a><a href="MAILTO:z@z.io">'))
    return B.read(s, d, "pages").select("page_id", F.array_join(email.mailto_emails(html), ",").alias("emails"))


_SECURITY = ("# policy\nContact: mailto:Sec@acme.io\nExpires: never", "  contact: sec@acme.io  ", "<!DOCTYPE html><p>Contact: a@b.io", "Policy: https://acme.io", "")


@query(f"""SELECT event_id, {case("event_id % 5", {0: "sec@acme.io", 1: "sec@acme.io", 2: "a@b.io"}).replace("WHEN 2 THEN 'a@b.io'", "WHEN 2 THEN NULL")} AS contact, event_id % 5 < 2 AS is_policy,
  CASE WHEN event_id % 2 = 1 THEN false WHEN event_id % 5 < 2 THEN true END AS found FROM events""")
def security_policies(s, d):
    """The contact line; is the body a policy; and what a fetch of it says: absent, there, or unknown."""
    body = pick_of(_SECURITY, F.col("event_id") % 5)
    return _events(s, d).select("event_id", email.security_contact(body).alias("contact"), text.is_security_txt(body).alias("is_policy"),
        details.security_txt(F.when(F.col("event_id") % 2 == 1, 404).otherwise(200), body).alias("found"))


_COMMENTS = ("Acme | Dhaka | Remote", "One - two", "No separator here", " | nothing before", "<p>Tags &amp; all</p> – rest")


@query(f"SELECT event_id, {case('event_id % 5', {0: 'Acme', 1: 'One', 2: 'No separator here', 3: ' | nothing before', 4: 'Tags & all'})} AS title FROM events")
def comment_titles(s, d):
    body = pick_of(_COMMENTS, F.col("event_id") % 5)
    return _events(s, d).select("event_id", text.comment_title(F.when(F.col("event_id") % 5 == 4, text.strip_tags(body)).otherwise(body)).alias("title"))


_LINKS = ('<a href="https://github.com/x">x</a> https://acme.io/jobs', 'https://www.acme.io/a). <a href="https://b.io/c">', "https://news.ycombinator.com/item?id=1",
    "no link")


@query(f"SELECT event_id, {case('event_id % 4', {0: 'https://acme.io/jobs', 1: 'https://b.io/c'})} AS url FROM events")
def company_links(s, d):
    return _events(s, d).select("event_id", url.first_company_url(pick_of(_LINKS, F.col("event_id") % 4)).alias("url"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://acme.io/x' WHEN 1 THEN 'https://home.io' WHEN 2 THEN 'http://other.io/' END AS target FROM events")
def extraction_targets(s, d):
    i = F.col("event_id") % 4
    return _events(s, d).select("event_id",
        url.extraction_target(pick_of(("https://acme.io/x", "https://github.com/a", "https://github.com/b", "https://github.com/c"), i),
        pick_of(("home.io", "home.io", "http://other.io/", ""), i)).alias("target"))


_ANGLES = ("You published T1_AI_SHIP last week", "We offer an ai_llm_assessment", "A plain sentence", "T3_HIRING_SEC and snapshot_free")


@query(f"SELECT event_id, {case('event_id % 4', {0: 'T1_AI_SHIP', 1: 'ai_llm_assessment', 2: '', 3: 'T3_HIRING_SEC,snapshot_free'})} AS leaked, CASE WHEN event_id % 4 = 2 THEN 'A plain sentence' ELSE '' END AS said FROM events")
def leaked_codes(s, d):
    a = pick_of(_ANGLES, F.col("event_id") % 4)
    return _events(s, d).select("event_id", F.array_join(text.leaked_codes(a), ",").alias("leaked"), text.publishable(a).alias("said"))


_REASONS = ("paused by the thermal governor", "Connection refused", "schema invalid", "read timed out")


@query("SELECT event_id, event_id % 4 = 0 AS thermal, event_id % 4 IN (1, 3) AS transient FROM events")
def failure_reasons(s, d):
    r = pick_of(_REASONS, F.col("event_id") % 4)
    return _events(s, d).select("event_id", text.reason_is(r, "thermal").alias("thermal"), text.reason_is(r, "connection", "timed out").alias("transient"))


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN '{"a": {"b": ' || event_id || '}}' END AS body FROM events""")
def outer_json(s, d):
    i = F.col("event_id")
    said = F.when(i % 3 > 0, F.concat(F.lit("Here it is:\n```json\n"), F.lit('{"a": {"b": '), _s(i), F.lit("}}"), F.lit("\n``` done"))).otherwise("nothing")
    return _events(s, d).select("event_id", text.outer_json(said).alias("body"))


@query("SELECT event_id, event_id % 4 = 0 AS valid, CASE WHEN event_id % 4 = 0 THEN 'Acme ' || event_id END AS display_name FROM events")
def extraction_bounds(s, d):
    """Answers of a model: one within the bounds, one with a name too long, one with an unknown code, one that is no JSON."""
    i = F.col("event_id")
    name = F.when(i % 4 == 1, F.repeat(F.lit("x"), F.lit(81))).otherwise(F.concat(F.lit("Acme "), _s(i)))
    code = F.when(i % 4 == 2, "T99_NONE").otherwise("T1_AI_SHIP")
    body = F.when(i % 4 == 3, "no answer").otherwise(F.concat(F.lit("Sure: "), F.to_json(F.struct(name.alias("display_name"), F.array(code).alias("trigger_codes")))))
    x = details.extraction(body)
    return _events(s, d).select("event_id", x.isNotNull().alias("valid"), x["display_name"].alias("display_name"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'T1_AI_SHIP' WHEN 1 THEN 'T2_FUNDING' ELSE '' END AS codes FROM events""")
def stored_codes(s, d):
    i = F.col("event_id") % 3
    none = F.array().cast("array<string>")
    return _events(s, d).select("event_id",
        F.array_join(details.stored_codes(F.when(i == 0, F.array(F.lit("T1_AI_SHIP"))).otherwise(none),
        F.when(i == 1, F.array(F.lit("T2_FUNDING"), F.lit("X"))).otherwise(none)), ",").alias("codes"))


_DOMAINS = ("acme.gov.bd", "gov.uk", "x.mil", "agov.com", "acme.io", "")


@query("SELECT event_id, event_id % 6 < 3 AS government FROM events")
def government_domains(s, d):
    return _events(s, d).select("event_id", url.has_government_suffix(pick_of(_DOMAINS, F.col("event_id") % 6)).alias("government"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'is_business_not_individual' ELSE '' END AS vetoes FROM events")
def business_rule(s, d):
    none = F.array(F.lit("x"))
    checks = rules.rules(none, none, F.lit(False), none, F.lit(None).cast("string"), F.lit("acme.io"), F.lit("software"), F.lit("Acme"),
        business=F.col("event_id") % 2 == 1)
    return _events(s, d).select("event_id", F.array_join(rules.verdict(checks)["vetoes"], ",").alias("vetoes"))


@query("SELECT event_id, status IN ('verified', 'role_account', 'catch_all') AS usable FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'role_account' WHEN 2 THEN 'catch_all' WHEN 3 THEN 'risky' ELSE 'unverified' END AS status FROM events)")
def usable_contacts(s, d):
    return _events(s, d).select("event_id",
        email.usable(pick_of(("verified", "role_account", "catch_all", "risky", "unverified"), F.col("event_id") % 5)).alias("usable"))


@query("SELECT event_id, length('Title') + length(event_type) + 10 AS n FROM events")
def message_sizes(s, d):
    from .operators import cards

    fields = F.array(F.struct(F.lit("name").alias("name"), F.lit("value").alias("value")), F.struct(F.lit("").alias("name"), F.lit("x").alias("value")))
    return _events(s, d).select("event_id", cards.rendered_size(F.lit("Title"), F.col("event_type"), fields).cast("long").alias("n"))


@query("""SELECT event_id, CAST(CASE WHEN d + f + 1323 <= 6000 OR d > d + f + 1323 - 6000 + 16 THEN m
    ELSE len(list_filter(range(1, m + 1), lambda k: 500 * k + 2 * least(k, 9) + 3 * greatest(0, k - 9) <= 6000 - d - 1323)) END + 2 AS INT) AS n_fields, true AS fits
  FROM (SELECT event_id, 5 * (event_id % 800) AS d, event_id % 20 + 1 AS m, 500 * (event_id % 20 + 1) + 2 * least(event_id % 20 + 1, 9) + 3 * greatest(0,
  event_id % 20 - 8) AS f FROM events)""")
def fitted_cards(s, d):
    """Cards of any length, cut to a message's limit: how many fields are left."""
    i = F.col("event_id")
    f = lambda n, c: F.struct(n.alias("name"), F.repeat(F.lit("v"), c).alias("value"))
    fields = F.concat(F.transform(F.sequence(F.lit(1), (i % 20 + 1).cast("int")), lambda k: f(F.concat(F.lit("f"), _s(k)), F.lit(500))),
        F.array(f(F.lit("📎 Evidence"), F.lit(1000)), f(F.lit("⚖️ Compliance"), F.lit(300))))
    x = details.fit_total(F.repeat(F.lit("word "), (i % 800).cast("int")), fields, C.PAGE_CHARS)
    size = F.length("x.description") + F.aggregate("x.fields", F.lit(0), lambda a, v: a + F.length(v["name"]) + F.length(v["value"]))
    return _events(s, d).select("event_id", x.alias("x")).select("event_id", F.size("x.fields").alias("n_fields"), (size <= C.PAGE_CHARS).alias("fits"))


# ------------------------------------------------------------------------------------------------ stage bodies


@query("""SELECT template, title, url FROM (SELECT 'tpl_' || event_id % 40 AS template, CASE
    WHEN event_id % 10 = 0 THEN 'Ask: Who is hiring' ELSE event_type END AS title, 'https://s/' || event_id AS url, event_id FROM events) WHERE event_id % 10 <> 0
  UNION ALL SELECT t.template, c.event_type, 'https://c/' || c.event_id FROM (SELECT *, row_number() OVER (PARTITION BY template ORDER BY ts DESC, event_id) AS r
  FROM (SELECT 'tpl_' || event_id % 40 AS template, event_id, ts FROM events WHERE event_id % 10 = 0)) t
  JOIN events c ON c.event_id % 1000 = t.event_id % 1000 AND c.event_id % 2 = 0 WHERE t.r <= 3""")
def expanded_threads(s, d):
    """Threads of a template become their comments, at most three threads, the newest first."""
    i = F.col("event_id")
    e = _events(s, d)
    stories = e.select(F.concat(F.lit("tpl_"), _s(i % 40)).alias("template"), i.alias("story_id"),
        F.when(i % 10 == 0, "Ask: Who is hiring").otherwise(F.col("event_type")).alias("title"), F.concat(F.lit("https://s/"), _s(i)).alias("url"),
        F.col("ts").alias("published_at"), (i % 1000).alias("m"))
    comments = e.where(i % 2 == 0).select((i % 1000).alias("m"), F.col("event_type").alias("title"), F.concat(F.lit("https://c/"), _s(i)).alias("url"))
    return details.expand_threads(stories, comments, "who is hiring", 3, "m")


@query("""SELECT event_id, '{"url":"https://t/' || event_id || '","discovered_at":"https://u/' || event_id || '","title":"' || event_type || '","snippet":"s","targets":["T1_AI_SHIP"],"template_id":"tpl_1"}' AS raw_payload FROM events""")
def candidate_payloads(s, d):
    i = F.col("event_id")
    x = _events(s, d).select("event_id", F.concat(F.lit("https://t/"), _s(i)).alias("target"), F.concat(F.lit("https://u/"), _s(i)).alias("url"),
        F.col("event_type").alias("title"), F.lit("s").alias("snippet"), F.array(F.lit("T1_AI_SHIP")).alias("targets"), F.lit("tpl_1").alias("template"))
    return details.payload(x).select("event_id", "raw_payload")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'job' WHEN 1 THEN 'stored' END AS template FROM events")
def stored_templates(s, d):
    i = F.col("event_id") % 3
    return _events(s, d).select("event_id", details.template_of(F.when(i == 0, "job").when(i == 1, ""),
        F.when(i == 1, '{"template_id":"stored"}').when(i == 2, "junk")).alias("template"))


@query("SELECT 't' || event_id AS template, CASE WHEN event_id % 2 = 0 THEN 'language,tags' ELSE 'tags' END AS params, CAST(greatest(1, event_id % 5) AS INT) AS ttl_hours FROM events")
def template_plans(s, d):
    i = F.col("event_id")
    x = _events(s, d).select(F.concat(F.lit("t"), _s(i)).alias("template"), F.lit("web").alias("engine"), F.lit("q").alias("query"), F.lit("story").alias("tags"),
        F.when(i % 2 == 0, "en").alias("language"), F.lit(None).cast("string").alias("title_contains"), (i % 5).cast("int").alias("ttl_hours"))
    return details.plan_rows(x).select("template", F.array_join(F.array_sort(F.map_keys("params")), ",").alias("params"), "ttl_hours")


@query("SELECT 'd' || user_id AS domain, min(event_id) AS board FROM events WHERE value >= 50 GROUP BY user_id")
def first_boards(s, d):
    x = _events(s, d).select(F.concat(F.lit("d"), _s(F.col("user_id"))).alias("domain"), F.col("event_id").alias("board"), F.col("event_id").alias("rank"),
        F.when(F.col("value") >= 50, 3).otherwise(0).alias("n_postings"), F.lit("u").alias("url"))
    return details.first_board(x).select("domain", "board")


@query("SELECT page_id % 20 AS domain, string_agg('p' || page_id || '@acme.io', ',' ORDER BY page_id) AS emails FROM (SELECT min(page_id) AS page_id FROM pages WHERE page_id > 0 GROUP BY page_id % 20) GROUP BY page_id % 20")
def site_findings(s, d):
    """Of each domain the pages up to the first with an address: here the first, whose address it is."""
    p = B.read(s, d, "pages").where("page_id > 0").select((F.col("page_id") % 20).alias("domain"), F.col("page_id").alias("rank"),
        F.concat("html", F.lit('<a href="mailto:p'), _s(F.col("page_id")), F.lit('@acme.io">')).alias("html"))
    return details.site_findings(p).select("domain", F.array_join("emails", ",").alias("emails"))


@query("""SELECT event_id, round(CAST('0x' || left(sha256(event_id || ':' || event_id % 12), 8) AS BIGINT) / 4294967296.0 * least(60.0, pow(2.0, event_id % 12)), 6) AS seconds FROM events""")
def backoff_bounds(s, d):
    """Each job's delay at its attempt: drawn by its key below the doubled base, at most the cap."""
    delay = details.backoff((F.col("event_id") % 12).cast("double"), key=F.col("event_id"))
    return _events(s, d).select("event_id", F.round(delay, 6).alias("seconds"))
