"""Queries over documents, stored pages, conversations and model replies."""

from pyspark.sql import functions as F

from hustings import vocab
from hustings.functions import text, web
from hustings.functions.rules import Rule, topic_rules
from hustings.operators import annotate, pages, reports
from hustings.plans.fixtures import PART_TYPES, SINCE, Views
from hustings.plans.registry import query
from hustings.sources import files

STRIP = r"'^\s+|\s+$', '', 'g'"


# Entities that are decoded without their semicolon as well.
BARE = ("&lt;", "&gt;", "&quot;", "&nbsp;", "&middot;", "&copy;", "&amp;", "&#39;")


def sql_unescape(x: str) -> str:
    for entity, char in web.COMMON_ENTITIES.items():
        char = char.replace("'", "''")
        if entity in BARE:
            x = f"regexp_replace({x}, '{entity}?', '{char}', 'g')"
        else:
            x = f"replace({x}, '{entity}', '{char}')"
    return x


def sql_tags(x: str) -> str:
    """Blocks to newlines, other tags to spaces."""
    x = rf"regexp_replace({x}, '<br\s*/?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '</(p|h[1-6]|div|li|tr)>', chr(10), 'g')"
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def sql_blanks(x: str, blank: str = r"\n\s*\n+") -> str:
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '{blank}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, {STRIP})"


def sql_strip_tags(x: str) -> str:
    return sql_blanks(sql_tags(sql_unescape(x)))


# --- pages -----------------------------------------------------------------------


@query("scan_pages", "SELECT page_id, url, html FROM pages")
def scan_pages(t: Views):
    return files.scan_pages(t.spark, f"{t.dir}/pages.parquet")


_SCRIPTS = r"regexp_replace({x}, '(?is)<script\b.*?</script>', ' ', 'g')"
_STYLES = r"regexp_replace({x}, '(?is)<style\b.*?</style>', ' ', 'g')"
_PAGE = sql_blanks(sql_tags(_STYLES.format(x=_SCRIPTS.format(x=sql_unescape("html")))))


@query("page_text", f"SELECT page_id, {_PAGE} AS text FROM pages")
def page_text(t: Views):
    return t.table("pages").select("page_id", web.strip_tags(F.col("html"), scripts=True).alias("text"))


_ARTICLE = sql_tags(sql_unescape("regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1)"))
for _left in (r"body\s*\{[^}]*\}", r"p\s*\{[^}]*\}", r"li,\s*table\s*\{[^}]*\}", r"\.awlist\d+[^}]*\}"):
    _ARTICLE = f"regexp_replace({_ARTICLE}, '{_left}', '', 'g')"
_ARTICLE = sql_blanks(_ARTICLE, r"\n\s*\n")


@query("article_text", f"SELECT page_id, {_ARTICLE} AS text FROM pages")
def article_text(t: Views):
    return t.table("pages").select("page_id", web.article_text(F.col("html")).alias("text"))


@query(
    "page_meta",
    r"""SELECT doc_id, regexp_replace(source, '^\s+|\s+$', '', 'g') AS lodged_by,
          lang || ' ' || n_chars AS published_date,
          CASE WHEN n_chars % 2 = 0 THEN CAST(n_chars AS VARCHAR) END AS debate_date, word_count
        FROM (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS word_count
              FROM documents)""",
)
def page_meta(t: Views):
    """Metadata of pages composed from the documents."""
    html = F.concat(
        F.lit("<p>Lodged by : "),
        "source",
        F.lit(" </p>\n<p>Published on: "),
        "lang",
        F.lit(" "),
        F.col("n_chars").cast("string"),
        F.lit("\n</p>"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("Debate date:"), F.col("n_chars").cast("string")))
        .otherwise(""),
        F.lit("<article>"),
        "text",
        F.lit("</article>"),
    )
    composed = t.table("documents").select("doc_id", "text", html.alias("html"))
    return composed.select(
        "doc_id",
        web.page_meta(F.col("html")).alias("m"),
        text.word_count(F.col("text")).cast("long").alias("word_count"),
    ).select("doc_id", "m.*", "word_count")


_HREF = r"""(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']+)["''][^>]*>(.*?)</a>"""
LINKS = rf"""anchors AS (SELECT page_id, url AS base, unnest(list_zip(
      regexp_extract_all(html, '{_HREF}', 1), regexp_extract_all(html, '{_HREF}', 2),
      range(1, len(regexp_extract_all(html, '{_HREF}', 1)) + 1))) AS a FROM pages),
  targets AS (SELECT page_id, a[3] AS pos, base,
      regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || regexp_replace(trim(a[1]), '#.*$', '') AS url,
      trim(regexp_replace({sql_unescape("regexp_replace(a[2], '<[^>]+>', ' ', 'g')")}, '\s+', ' ', 'g'))[1:80] AS text
    FROM anchors WHERE starts_with(trim(a[1]), '/')),
  firsts AS (SELECT * FROM targets WHERE text <> '' AND url <> base
    QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1),
  links AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS position, text, url
    FROM firsts QUALIFY position <= 40)"""


@query("internal_links", f"WITH {LINKS} SELECT * FROM links")
def internal_links(t: Views):
    return pages.internal_links(t.table("pages"))


@query(
    "chapter_links",
    rf"""WITH {LINKS} SELECT page_id, position, text, url, path
         FROM (SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM links)
         WHERE path NOT IN ('', '/') AND regexp_matches(path[2:], '\p{{Lu}}| |%20')
         QUALIFY row_number() OVER (PARTITION BY page_id, path ORDER BY position) = 1""",
)
def chapter_links(t: Views):
    return pages.chapter_links(pages.internal_links(t.table("pages")))


@query(
    "url_whitelist",
    f"""WITH {LINKS}, offered AS (SELECT page_id, list(url) AS urls, list(url ORDER BY position) AS in_order
          FROM links GROUP BY page_id)
        SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN in_order[1] END AS next_url,
          CASE WHEN page_id % 3 = 0 THEN array_to_string(in_order[1:25], '|') ELSE '' END AS aggregate_urls
        FROM pages LEFT JOIN offered USING (page_id)""",
)
def url_whitelist(t: Views):
    """Replies suggest offered and foreign URLs; only offered ones stay."""
    links = pages.internal_links(t.table("pages"))
    own = links.groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda x: x["url"]).alias("urls")
    )
    foreign = F.array(F.lit("https://elsewhere.example.org/"), F.lit(" "))
    listed = F.when(F.col("page_id") % 3 == 0, F.concat(foreign, F.col("urls"), F.col("urls")))
    replies = t.table("pages").select("page_id").join(own, "page_id", "left").select(
        "page_id",
        F.concat(F.lit(" "), F.try_element_at("urls", F.lit(1)), F.lit(" ")).alias("next_url"),
        listed.alias("aggregate_urls"),
    )
    kept = annotate.url_whitelist(replies, links)
    joined = F.array_join("aggregate_urls", "|")
    no_links = (F.col("page_id") % 3 == 0) & F.col("next_url").isNull() & (joined == "")
    return kept.select(
        "page_id", "next_url", F.when(no_links, None).otherwise(joined).alias("aggregate_urls")
    )


# Index pages composed from the suppliers: two cards each, the second a repeat.
def index_pages(t: Views):
    key = F.col("s_suppkey")
    card = F.concat(
        F.lit('<figure class="x" data-testid="profile-card">\n<a href="https://polls.example.org/candidates/2026/s-'),
        key.cast("string"),
        F.lit('/?from=index"><img alt="" src="/img/'),
        key.cast("string"),
        F.lit('.jpg"></a><h5 class="h" data-testid="profile-card-heading"><a href="#"> '),
        F.col("s_name"),
        F.lit(" &amp; Co </a></h5><ul><li>"),
        F.when(key % 4 == 0, "None").otherwise("Party &quot;A&quot;"),
        F.lit("</li><li> </li><li><b>Standing for</b> "),
        F.when(key % 3 == 0, "connetable of").when(key % 3 == 1, "DEPUTY.").otherwise("island senator"),
        F.lit("</li><li>St. Area "),
        F.col("s_nationkey").cast("string"),
        F.lit("</li></ul></figure>"),
    )
    return t.table("supplier").select(
        key.alias("page_id"), F.concat(F.lit("<html>"), card, F.lit("<hr>"), card, F.lit("</html>")).alias("html")
    )


@query(
    "card_explode",
    """SELECT s_suppkey AS page_id, 0 AS pos, 's-' || s_suppkey AS slug,
         'https://polls.example.org/candidates/2026/s-' || s_suppkey || '/' AS profile_url,
         s_name || ' & Co' AS full_name, '/img/' || s_suppkey || '.jpg' AS photo_url,
         ['Connétable', 'Deputy', 'Island Senator'][s_suppkey % 3 + 1] AS role,
         'St Area ' || s_nationkey AS constituency,
         CASE WHEN s_suppkey % 4 <> 0 THEN 'Party "A"' END AS party FROM supplier""",
)
def card_explode(t: Views):
    return pages.card_explode(index_pages(t), "https://polls.example.org")


def profile_pages(t: Views):
    """Profile pages composed from the documents; some lack the structural block."""
    doc = F.col("doc_id")
    block = F.concat(
        F.lit('<div class="main-content inline-col w-3/4"><iframe src="v">skip</iframe>'),
        F.lit('<div class="embed-x">skip</div><h2>Text</h2>'),
        "text",
        F.lit("</div>"),
    )
    side = F.concat(
        F.lit("<p>No previous convictions</p><p>"),
        "text",
        F.lit("</p><p>Names of Proposers and Seconders</p>"),
    )
    return t.table("documents").select(
        "doc_id",
        F.concat(
            F.lit("<html><body>"),
            F.when(doc % 3 != 0, block).otherwise(""),
            F.lit("<aside>x</aside>"),
            F.when(doc % 2 == 0, side).otherwise(""),
            F.lit("</body></html>"),
        ).alias("html"),
    )


_PROFILE = """SELECT doc_id, '<html><body>' || CASE WHEN doc_id % 3 <> 0 THEN
    '<div class="main-content inline-col w-3/4"><iframe src="v">skip</iframe><div class="embed-x">skip</div><h2>Text</h2>'
    || text || '</div>' ELSE '' END || '<aside>x</aside>' || CASE WHEN doc_id % 2 = 0 THEN
    '<p>No previous convictions</p><p>' || text || '</p><p>Names of Proposers and Seconders</p>' ELSE '' END
    || '</body></html>' AS html FROM documents"""
_INNER = (
    "regexp_extract(html, '(?s)<div class=\"main-content inline-col[^\"]*\"[^>]*>(.*?)"
    '(?:<div id="js-main-content"|<aside|Names of Proposers and Seconders)\', 1)'
)
_INNER = f"regexp_replace({_INNER}, '(?s)<iframe.*?</iframe>', '', 'g')"
_INNER = f"regexp_replace({_INNER}, '(?s)<div class=\"embed[^\"]*\"[^>]*>.*?</div>', '', 'g')"
_WORDS = r"len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> ''))"


def sql_between(x: str, starts: list[str], ends: list[str]) -> str:
    low = f"lower({x})"
    begin = "coalesce(" + ", ".join(
        f"CASE WHEN instr({low}, '{a.lower()}') > 0 THEN instr({low}, '{a.lower()}') + {len(a)} END" for a in starts
    ) + ")"
    rest = f"{x}[{begin}:]"
    stop = ", ".join(f"nullif(instr(lower({rest}), '{a.lower()}'), 0)" for a in ends)
    cut = f"{rest}[1:coalesce({stop}, length({rest}) + 1) - 1]"
    return f"CASE WHEN {begin} IS NULL THEN '' ELSE regexp_replace({cut}, {STRIP}) END"


@query(
    "main_content",
    f"""WITH html AS ({_PROFILE}), parts AS MATERIALIZED (SELECT doc_id, {sql_strip_tags(_INNER)} AS block,
          {sql_strip_tags("html")} AS whole FROM html),
        found AS (SELECT doc_id, block,
          {sql_between("whole", vocab.CONVICTION_ANCHORS, vocab.PROPOSER_ANCHORS)} AS anchored FROM parts)
        SELECT doc_id, CASE WHEN {_WORDS.format(x="block")} < 30
          AND {_WORDS.format(x="anchored")} > {_WORDS.format(x="block")} THEN anchored ELSE block END AS content
        FROM found""",
)
def main_content(t: Views):
    return profile_pages(t).select("doc_id", web.main_content(F.col("html")).alias("content"))


# --- documents -------------------------------------------------------------------


@query(
    "content_status",
    f"""SELECT doc_id, CAST(n AS INTEGER) AS words, CASE WHEN n = 0 THEN 'error' WHEN n < 150 THEN 'low_content' ELSE 'ok' END
          AS status FROM (SELECT doc_id, {_WORDS.format(x="text")} AS n FROM documents)""",
)
def content_status(t: Views):
    body = F.col("text")
    return t.table("documents").select(
        "doc_id", text.word_count(body).alias("words"), text.content_status(body).alias("status")
    )


STARTS, ENDS = ["that this", "the en", "und der", " de la "], [" of ", " der ", " le ", "."]


@query("between_anchors", f"SELECT doc_id, {sql_between('text', STARTS, ENDS)} AS part FROM documents")
def between_anchors(t: Views):
    return t.table("documents").select(
        "doc_id", text.between_anchors(F.col("text"), STARTS, ENDS).alias("part")
    )


@query(
    "contacts",
    rf"""SELECT doc_id, nullif(regexp_extract(text, '{vocab.EMAIL_PATTERN}'), '') AS email,
          regexp_replace(nullif(regexp_extract(text, '{vocab.PHONE_PATTERN}'), ''), {STRIP}) AS phone,
          CASE WHEN lower(p) IN ('none', 'independent', 'n/a', '-') THEN 'Independent' ELSE p END AS party
        FROM (SELECT *, regexp_replace(nullif(regexp_extract(text, '(?:Party|Affiliation)\s*[:\-]\s*([^\n]+)', 1), ''), {STRIP}) AS p
              FROM (SELECT doc_id, text || chr(10) || 'Party: ' ||
                CASE WHEN lang = 'en' THEN 'None' ELSE source END AS text FROM documents))""",
)
def contacts(t: Views):
    labelled = F.concat(
        "text", F.lit("\nParty: "), F.when(F.col("lang") == "en", "None").otherwise(F.col("source"))
    )
    return t.table("documents").select("doc_id", text.contacts(labelled).alias("c")).select("doc_id", "c.*")


RULES = [
    Rule("Finance & Taxation", [r" tion .* the ", r"budget\b", r" und die "], [r"keitung", r" aux "]),
    Rule("Housing", [r"heitung", r"eauou"], []),
    Rule("Health & Wellbeing", [r" que .* pas ", r"ción "], [r" para .{0,40} los "]),
    Rule("Justice & Policing", [r" of .* was "], []),
]


def sql_rules(x: str) -> str:
    cases = []
    for r in RULES:
        hit = " OR ".join(f"regexp_matches({x}, '{p}')" for p in r.patterns)
        miss = " AND ".join(f"NOT regexp_matches({x}, '{p}')" for p in r.unless) or "true"
        cases.append(f"WHEN ({hit}) AND {miss} THEN '{r.category}'")
    return "CASE " + " ".join(cases) + " END"


@query("topic_rules", f"SELECT doc_id, {sql_rules('lower(text)')} AS topic FROM documents")
def topic_rules_(t: Views):
    return t.table("documents").select("doc_id", topic_rules(F.col("text"), RULES).alias("topic"))


@query(
    "topic_totals",
    f"""SELECT topic AS label, count(*) AS n FROM
          (SELECT {sql_rules('lower(text)')} AS topic FROM documents
           UNION ALL SELECT {sql_rules('lower(text)')} FROM conversations) WHERE topic IS NOT NULL GROUP BY 1""",
)
def topic_totals(t: Views):
    """Category totals of two classified tables, added."""
    def counts(name: str):
        found = t.table(name).select(topic_rules(F.col("text"), RULES).alias("label"))
        return found.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))

    return reports.added_counts(counts("documents"), counts("conversations"))


HEADED = "regexp_replace(text, '(?m)^([A-M][^ \\n]*)', '**\\1** ', 'g')"


@query(
    "sections",
    rf"""WITH headed AS (SELECT doc_id, {HEADED} AS text FROM documents),
        lines AS (SELECT doc_id, unnest(list_zip(string_split(text, chr(10)),
          range(1, len(string_split(text, chr(10))) + 1))) AS l FROM headed),
        kept AS (SELECT doc_id, l[1] AS line, l[2] AS no, regexp_matches(l[1], '^\*\*(.+?)\*\*\s*(.*)') AS head
          FROM lines WHERE trim(l[1]) <> ''),
        numbered AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS sec FROM kept)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) AS INTEGER) AS position,
          coalesce(max(CASE WHEN head THEN regexp_extract(line, '^\*\*(.+?)\*\*\s*(.*)', 1) END), '') AS title,
          coalesce(string_agg(CASE WHEN head THEN nullif(regexp_extract(line, '^\*\*(.+?)\*\*\s*(.*)', 2), '')
            ELSE line END, ' ' ORDER BY no), '') AS body
        FROM numbered GROUP BY doc_id, sec""",
)
def sections(t: Views):
    headed = F.regexp_replace("text", r"(?m)^([A-M][^ \n]*)", "**$1** ")
    return (
        t.table("documents")
        .select("doc_id", F.posexplode(text.sections(headed)).alias("pos", "s"))
        .select("doc_id", (F.col("pos") + 1).alias("position"), "s.title", "s.body")
    )


@query(
    "assemble_document",
    r"""SELECT conv_id, count(*) AS parts, string_agg('## ' || title || chr(10) || chr(10) ||
          CASE WHEN starts_with(lower(body), lower(title))
               THEN regexp_replace(body[length(title) + 1:], '^[ /\n]+', '') ELSE body END,
          chr(10) || chr(10) ORDER BY turn)[1:200000] AS document
        FROM (SELECT conv_id, turn, regexp_extract(text, '^\s*(\S+)', 1) || CASE WHEN role = 'user' THEN '' ELSE role END
                AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM conversations)
        GROUP BY conv_id""",
)
def assemble_document(t: Views):
    """Turns as chapters; the title of a user's turn repeats its first word."""
    word = F.regexp_extract("text", r"^\s*(\S+)", 1)
    title = F.concat(word, F.when(F.col("role") == "user", "").otherwise(F.col("role")))
    parts = t.table("conversations").select(
        "conv_id", "turn", pages.chapter_text(title, F.col("text")).alias("part")
    )
    return pages.assemble_document(parts, "conv_id", "turn")


def sub_pages(t: Views):
    """Stored pages as sub-pages of 17 indexes, each with two made-up links from its id."""
    sub = t.table("pages").select(
        (F.col("page_id") % 17).alias("index_id"), F.col("page_id").alias("page"), "url",
        F.when(F.col("page_id") % 5 != 0, F.concat(F.lit("About "), "url")).otherwise("").alias("text"),
    )
    target = F.explode(F.array(F.col("page") % 97, F.col("page") * 7 % 89)).alias("n")
    links = sub.select("index_id", "page", target).select(
        "index_id", "page", F.col("n").alias("position"), F.concat(F.lit("https://l.example/"), F.col("n").cast("string")).alias("url"),
        F.concat(F.lit("to "), F.col("n").cast("string")).alias("text"),
    )
    return pages.aggregate_pages(sub, links, "index_id", cap=12)


SUB_PAGES = r"""sub AS (SELECT page_id % 17 AS index_id, page_id AS page, url,
    coalesce(nullif(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*?)(;[^/]*)?/*$', 1), ''), url) AS heading
    FROM pages WHERE page_id % 5 <> 0),
  links AS (SELECT index_id, page, unnest([page % 97, page * 7 % 89]) AS n FROM sub),
  firsts AS (SELECT index_id, n, min((page, n)) AS pos FROM links GROUP BY ALL),
  kept AS (SELECT index_id, n, pos[1] AS page, row_number() OVER (PARTITION BY index_id ORDER BY pos) AS place FROM firsts QUALIFY place <= 12)"""


@query(
    "subpage_document",
    f"""WITH {SUB_PAGES} SELECT index_id, count(*) AS parts,
          string_agg('## ' || heading || chr(10) || chr(10) || 'About ' || url, chr(10) || chr(10) ORDER BY page)[1:200000] AS document
        FROM sub LEFT JOIN (SELECT index_id, page AS stop_page FROM kept WHERE place = 12) USING (index_id)
        WHERE stop_page IS NULL OR page <= stop_page GROUP BY index_id""",
)
def subpage_document(t: Views):
    return sub_pages(t)[0]


@query(
    "subpage_links",
    f"""WITH {SUB_PAGES} SELECT index_id, CAST(place AS INTEGER) AS place, 'https://l.example/' || n AS url, 'to ' || n AS text FROM kept""",
)
def subpage_links(t: Views):
    return sub_pages(t)[1]


RUN = 8


def page_runs(t: Views):
    """Stored pages as sub-pages of indexes of eight, with their own text and the links of their html."""
    run = F.floor(F.col("page_id") / RUN).alias("index_id")
    stored = t.table("pages")
    sub = stored.select(run, F.col("page_id").alias("page"), "url", web.strip_tags(F.col("html"), scripts=True).alias("text"))
    links = pages.internal_links(stored).select(run, F.col("page_id").alias("page"), "position", "url", "text")
    return pages.aggregate_pages(sub, links, "index_id")


PAGE_RUNS = rf"""{LINKS}, sub AS (SELECT page_id // {RUN} AS index_id, page_id AS page, url, text,
    coalesce(nullif(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '([^/]*?)(;[^/]*)?/*$', 1), ''), url) AS heading
    FROM (SELECT page_id, url, {_PAGE} AS text FROM pages) WHERE text <> ''),
  firsts_of_run AS (SELECT index_id, l.url, min((page, l.position, l.text)) AS first
    FROM links l JOIN sub ON page = page_id GROUP BY ALL),
  kept AS (SELECT index_id, url, first[3] AS text, first[1] AS page,
    row_number() OVER (PARTITION BY index_id ORDER BY first[1], first[2]) AS place FROM firsts_of_run QUALIFY place <= 40)"""


@query(
    "page_run_document",
    f"""WITH {PAGE_RUNS} SELECT index_id, count(*) AS parts,
          string_agg('## ' || heading || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page)[1:200000] AS document
        FROM sub LEFT JOIN (SELECT index_id, page AS stop_page FROM kept WHERE place = 40) USING (index_id)
        WHERE stop_page IS NULL OR page <= stop_page GROUP BY index_id""",
)
def page_run_document(t: Views):
    return page_runs(t)[0]


@query("page_run_links", f"WITH {PAGE_RUNS} SELECT index_id, CAST(place AS INTEGER) AS place, url, text FROM kept")
def page_run_links(t: Views):
    return page_runs(t)[1]


# --- quotes and replies ----------------------------------------------------------

# A piece of each document, from anywhere in its text.
def sql_piece(size: int, step: int) -> str:
    return f"substr(text, doc_id * {step} % greatest(length(text) - {size}, 1) + 1, {size})"


def piece(size: int, step: int):
    start = F.col("doc_id") * step % F.greatest(F.length("text") - size, F.lit(1)) + 1
    return F.substr("text", start.cast("int"), F.lit(size))


# A quote of each document: as it stands, with typographic marks, or damaged.
FIRST, SECOND = (60, 37), (40, 101)
QUOTE = f"""CASE doc_id % 5 WHEN 0 THEN trim({sql_piece(*FIRST)}) || ' zzqx'
  WHEN 1 THEN translate({sql_piece(*FIRST)}, 'abcdefghijklm', 'ABCDEFGHIJKLM')
  WHEN 2 THEN replace(trim({sql_piece(*FIRST)}), ' ', '   ') WHEN 3 THEN '' ELSE {sql_piece(*FIRST)} END"""


def quote_of():
    part = piece(*FIRST)
    doc = F.col("doc_id") % 5
    return (
        F.when(doc == 0, F.concat(F.trim(part), F.lit(" zzqx")))
        .when(doc == 1, F.translate(part, "abcdefghijklm", "ABCDEFGHIJKLM"))
        .when(doc == 2, F.replace(F.trim(part), F.lit(" "), F.lit("   ")))
        .when(doc == 3, "")
        .otherwise(part)
    )


def sql_norm(x: str) -> str:
    return rf"trim(translate(regexp_replace(lower({x}), '\s+', ' ', 'g'), '‘’“”–—', '''''''''--'))"


@query(
    "quote_check",
    f"""SELECT doc_id, quote, quote <> '' AND contains({sql_norm("text")}, {sql_norm("quote")}) AS verbatim
        FROM (SELECT *, {QUOTE} AS quote FROM documents)""",
)
def quote_check(t: Views):
    return t.table("documents").select(
        "doc_id",
        quote_of().alias("quote"),
        text.quote_matches(F.col("text"), quote_of()).alias("verbatim"),
    )


def reply_of(items, broken=17, bare=13):
    """Items as a reply: some fenced, some cut off, some with a bare quotation mark."""
    doc = F.col("doc_id")
    json = F.to_json(items)
    json = F.when(doc % bare == 0, F.replace(json, F.lit("about"), F.lit('a"bout'))).otherwise(json)
    json = F.when(doc % broken == 0, F.substr(json, F.lit(1), F.length(json) - 2)).otherwise(json)
    return F.when(doc % 3 == 0, F.concat(F.lit("```json\n"), json, F.lit("\n```"))).otherwise(json)


def topic_replies(t: Views):
    doc = F.col("doc_id")
    topics = F.array(*[F.lit(x) for x in vocab.TOPICS])

    def item(shift: int, quote):
        return F.struct(
            F.when((doc + shift) % 7 == 0, "Unheard of")
            .otherwise(F.element_at(topics, ((doc + shift) % 16 + 1).cast("int")))
            .alias("topic"),
            (((doc + shift) % 13 - 1) / 9).alias("salience"),
            F.concat(F.lit(" about "), "source", F.lit(" ")).alias("summary"),
            quote.alias("source_quote"),
        )

    items = F.array(item(0, quote_of()), item(3, piece(*SECOND)), item(16, F.lit("")))
    return t.table("documents").select("doc_id", reply_of(items).alias("response_text"))


def source_documents(t: Views):
    return t.table("documents").select("doc_id", "text")


def topic_reply_sql() -> str:
    """The items of `topic_replies` that survive parsing, in order."""
    one = """SELECT doc_id, {no} AS no, text, CASE WHEN (doc_id + {s}) % 7 = 0 THEN 'Unheard of'
        ELSE {topics}[CAST((doc_id + {s}) % 16 + 1 AS INTEGER)] END AS topic,
      CAST((doc_id + {s}) % 13 - 1 AS DOUBLE) / 9 AS salience,
      CASE WHEN doc_id % 13 = 0 THEN 'a"bout ' ELSE 'about ' END || source AS summary, {quote} AS quote
      FROM documents WHERE doc_id % 17 <> 0"""
    topics = "[" + ", ".join(f"'{x}'" for x in vocab.TOPICS) + "]"
    quotes = [(0, QUOTE), (3, sql_piece(*SECOND)), (16, "''")]
    return " UNION ALL ".join(
        one.format(no=i, s=s, topics=topics, quote=q) for i, (s, q) in enumerate(quotes)
    )


@query(
    "clean_topics",
    rf"""WITH items AS ({topic_reply_sql()}), trimmed AS (SELECT * REPLACE (regexp_replace(quote, {STRIP}) AS quote) FROM items
          WHERE topic <> 'Unheard of' QUALIFY row_number() OVER (PARTITION BY doc_id, topic ORDER BY no) = 1)
        SELECT doc_id, topic, round(least(greatest(salience, 0), 1), 2) AS salience, summary,
          CASE WHEN quote <> '' AND contains({sql_norm("text")}, {sql_norm("quote")}) THEN quote ELSE '' END AS source_quote
        FROM trimmed""",
)
def clean_topics(t: Views):
    good, _ = annotate.parse_annotations(topic_replies(t), annotate.TOPIC_REPLY, numbers=["salience"])
    return annotate.clean_topics(good, source_documents(t))


@query(
    "parse_annotations",
    """SELECT doc_id, doc_id % 17 = 0 AS rejected, CASE WHEN doc_id % 17 <> 0 THEN 3 END AS items,
         CASE WHEN doc_id % 17 = 0 THEN 'not JSON' END AS reason FROM documents""",
)
def parse_annotations(t: Views):
    good, rejects = annotate.parse_annotations(
        topic_replies(t), annotate.TOPIC_REPLY, numbers=["salience"]
    )
    return good.select(
        "doc_id", F.lit(False).alias("rejected"), F.size("parsed").alias("items"), F.lit(None).cast("string").alias("reason")
    ).unionByName(
        rejects.select("doc_id", F.lit(True).alias("rejected"), F.lit(None).cast("int").alias("items"), "reason")
    )


def stance_questions(t: Views):
    return t.table("benchmark").select(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"),
        F.col("text").alias("statement"),
    )


STANCE_WORDS = ["agree", "disagree", "neutral", "not_addressed", "perhaps"]


def stance_replies(t: Views):
    doc = F.col("doc_id")
    words = F.array(*[F.lit(x) for x in STANCE_WORDS])

    def item(shift: int, quote):
        return F.struct(
            F.concat(F.lit("q"), ((doc * 7 + shift) % 50).cast("string")).alias("question_id"),
            F.element_at(words, ((doc + shift) % 5 + 1).cast("int")).alias("stance"),
            ((doc + shift) % 11 / 10).alias("confidence"),
            quote.alias("source_quote"),
        )

    items = F.array(item(0, quote_of()), item(3, piece(*SECOND)), item(53, F.lit("no such words")))
    return t.table("documents").select("doc_id", reply_of(items).alias("response_text"))


def _stance_sql() -> str:
    words = "[" + ", ".join(f"'{x}'" for x in STANCE_WORDS) + "]"
    one = """SELECT doc_id, {no} AS no, text, 'q' || ((doc_id * 7 + {s}) % 50) AS question_id,
      {words}[CAST((doc_id + {s}) % 5 + 1 AS INTEGER)] AS stance, CAST((doc_id + {s}) % 11 AS DOUBLE) / 10 AS confidence,
      {quote} AS quote FROM documents WHERE doc_id % 17 <> 0"""
    quotes = [(0, QUOTE), (3, sql_piece(*SECOND)), (53, "'no such words'")]
    items = " UNION ALL ".join(one.format(no=i, s=s, words=words, quote=q) for i, (s, q) in enumerate(quotes))
    return rf"""items AS ({items}), known AS (SELECT * REPLACE (regexp_replace(quote, {STRIP}) AS quote) FROM items
        WHERE question_id IN (SELECT 'q' || item_id FROM benchmark)
        QUALIFY row_number() OVER (PARTITION BY doc_id, question_id ORDER BY no) = 1),
      cleaned AS (SELECT doc_id, question_id, confidence, quote, CASE WHEN stance IN ('agree', 'disagree', 'neutral')
        AND quote <> '' AND contains({sql_norm("text")}, {sql_norm("quote")}) THEN stance ELSE 'not_addressed' END AS stance
        FROM known),
      stances AS (SELECT doc_id, question_id, stance, confidence,
        CASE WHEN stance = 'not_addressed' THEN '' ELSE quote END AS source_quote FROM cleaned)"""


def cleaned_stances(t: Views):
    good, _ = annotate.parse_annotations(
        stance_replies(t), annotate.STANCE_REPLY, numbers=["confidence"]
    )
    return good, annotate.clean_stances(good, source_documents(t), stance_questions(t))


@query("clean_stances", f"WITH {_stance_sql()} SELECT * FROM stances")
def clean_stances(t: Views):
    return cleaned_stances(t)[1]


@query(
    "fill_stances",
    f"""WITH {_stance_sql()} SELECT * FROM stances
        UNION ALL SELECT doc_id, 'q' || item_id, 'not_addressed', 0.5, '' FROM documents, benchmark
          WHERE doc_id % 17 <> 0 AND (doc_id, 'q' || item_id) NOT IN (SELECT (doc_id, question_id) FROM stances)""",
)
def fill_stances(t: Views):
    good, stances = cleaned_stances(t)
    return annotate.fill_stances(stances, good, stance_questions(t))


MARK = "<<<MANIFESTO>>>"


@query(
    "split_sentinel",
    rf"""SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN '' ELSE regexp_replace(text, {STRIP}) END AS manifesto_text,
          CASE WHEN doc_id % 4 = 1 AND doc_id % 9 <> 0 THEN 'https://example.org/' || doc_id END AS next_url,
          CASE WHEN doc_id % 9 <> 0 THEN 'a|' || source END AS aggregate_urls,
          CASE WHEN doc_id % 9 <> 0 THEN trim(('n' || repeat('o', CAST(doc_id % 700 AS BIGINT)))[1:500]) ELSE '' END AS note
        FROM documents""",
)
def split_sentinel(t: Views):
    doc = F.col("doc_id")
    header = F.to_json(
        F.struct(
            F.when(doc % 4 == 1, F.concat(F.lit("https://example.org/"), doc.cast("string")))
            .otherwise("")
            .alias("next_url"),
            F.array(F.lit("a"), F.col("source")).alias("aggregate_urls"),
            F.concat(F.lit(" n"), F.repeat(F.lit("o"), (doc % 700).cast("int"))).alias("note"),
        )
    )
    header = F.when(doc % 9 == 0, "not JSON").otherwise(F.concat(F.lit("Here you are: "), header))
    raw = F.when(doc % 6 == 5, header).otherwise(F.concat(header, F.lit("\n" + MARK), "text"))
    replies = t.table("documents").select("doc_id", raw.alias("raw"))
    split = annotate.split_sentinel(replies, "raw", MARK)
    return split.withColumn("aggregate_urls", F.array_join("aggregate_urls", "|"))


@query(
    "coerce_labels",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 2 THEN 'ECONOMY' WHEN 3 THEN 'LARGE' ELSE p_type END AS primary,
         CASE WHEN p_partkey % 3 = 0 THEN p_type END AS secondary,
         array_to_string((string_split(p_name, ' ') || string_split(p_name, ' ') || string_split(p_name, ' '))[1:5], '|') AS tags
       FROM part""",
)
def coerce_labels(t: Views):
    key, kind = F.col("p_partkey"), F.col("p_type")
    given = (
        F.when(key % 4 == 0, kind)
        .when(key % 4 == 1, F.concat(F.lit("the "), F.lower(kind), F.lit(" kind")))
        .when(key % 4 == 2, "")
        .otherwise("something else")
    )
    parts = F.split("p_name", " ")
    labels = t.table("part").select(
        "p_partkey",
        given.alias("primary"),
        F.when(key % 3 == 0, kind).when(key % 3 == 1, "None").otherwise("other").alias("secondary"),
        F.concat(parts, parts, parts).alias("tags"),
    )
    coerced = annotate.coerce_labels(labels, PART_TYPES, "LARGE")
    return coerced.withColumn("tags", F.array_join("tags", "|"))


# --- batches and open work -------------------------------------------------------


def document_batches(t: Views):
    return annotate.batches(
        t.table("documents").select("doc_id", "source", "n_chars"), 20, ["doc_id"], ["doc_id", "source"]
    )


@query(
    "batches",
    """SELECT (no - 1) // 20 AS batch_id, count(*) AS size,
         string_agg(((no - 1) % 20 + 1) || '. [' || source || '] ' || doc_id, chr(10) ORDER BY no) AS lines
       FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS no FROM documents) GROUP BY 1""",
)
def batches(t: Views):
    made = document_batches(t)
    lines = annotate.batch_prompt_lines(
        made, lambda i: F.concat(F.lit("["), i["source"], F.lit("] "), i["doc_id"].cast("string"))
    )
    return made.select("batch_id", F.size("items").cast("long").alias("size")).join(lines, "batch_id")


@query(
    "align_batches",
    """WITH numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS no FROM documents)
       SELECT doc_id, CASE WHEN (no // 20) % 4 = 3 OR doc_id % 3 = 0 THEN 'Government & Administration' ELSE 'Housing' END AS primary,
         CASE WHEN (no // 20) % 4 <> 3 AND doc_id % 2 = 0 THEN 'Justice & Policing' END AS secondary,
         CASE WHEN (no // 20) % 4 <> 3 THEN source ELSE '' END AS tags,
         CASE WHEN (no // 20) % 4 <> 3 THEN 'later ' || doc_id ELSE '' END AS summary
       FROM numbered WHERE (no // 20) % 4 = 3 OR no % 20 < 18""",
)
def align_batches(t: Views):
    """Replies name 18 of 20 rows twice and some that do not exist; every fourth fails."""
    made = document_batches(t)

    def result(item, word: str):
        return F.struct(
            F.when(item["index"] > 18, item["index"] + 20).otherwise(item["index"]).alias("index"),
            F.when(item["doc_id"] % 3 == 0, "Unheard of").otherwise("Housing").alias("primary"),
            F.when(item["doc_id"] % 2 == 0, "Justice & Policing").otherwise("nothing").alias("secondary"),
            F.array(item["source"]).alias("tags"),
            F.concat(F.lit(word), item["doc_id"].cast("string")).alias("summary"),
        )

    results = F.concat(
        F.transform("items", lambda i: result(i, "sooner ")), F.transform("items", lambda i: result(i, "later "))
    )
    text_ = F.when(F.col("batch_id") % 4 == 3, "Sorry, no.").otherwise(F.to_json(results))
    good, _ = annotate.parse_annotations(
        made.select("batch_id", text_.alias("response_text")), annotate.BATCH_REPLY
    )
    aligned = annotate.align_batches(made, good, "doc_id")
    return aligned.withColumn("tags", F.array_join("tags", "|"))


WORK_RULES = [
    Rule("STANDARD", [r"\banvil\b", r"\bred\b.*\bring\b"], [r"\bgreen\b"]),
    Rule("SMALL", [r"gear\b"], []),
]


@query(
    "annotation_worklist",
    r""", routed AS (SELECT *, CASE
            WHEN (regexp_matches(lower(title), '\banvil\b') OR regexp_matches(lower(title), '\bred\b.*\bring\b'))
              AND NOT regexp_matches(lower(title), '\bgreen\b') THEN 'STANDARD'
            WHEN regexp_matches(lower(title), 'gear\b') THEN 'SMALL'
            WHEN coalesce(topic_primary, '') NOT IN ('', 'ECONOMY') THEN topic_primary END AS topic FROM props)
       SELECT proposition_id, base_reference, title, CASE WHEN length(scraped_text) > 50 THEN scraped_text[1:2000] END
           AS excerpt, year, number, topic IS NULL AS needs_category, topic
       FROM routed WHERE trim(coalesce(plain_language_summary, '')) = ''""",
    "props",
)
def annotation_worklist(t: Views):
    return annotate.annotation_worklist(t.props, WORK_RULES, default="ECONOMY")


@query(
    "extended_worklist",
    """SELECT proposition_id, base_reference, title, scraped_text[1:2500] AS excerpt FROM props
       WHERE extended_summary IS NULL AND scraped_text IS NOT NULL AND proposition_id IN
         (SELECT proposition_id FROM divisions WHERE date >= TIMESTAMP '1995-04-01')""",
    "props divisions",
)
def extended_worklist(t: Views):
    return annotate.extended_worklist(t.props, t.divisions, SINCE).select(
        "proposition_id", "base_reference", "title", "excerpt"
    )


@query(
    "pending_pages",
    """SELECT proposition_id, base_reference, source_url, scrape_status FROM props
       WHERE scrape_status = 'pending' OR scrape_status IS NULL""",
    "props",
)
def pending_pages(t: Views):
    return annotate.pending_pages(t.props).select(
        "proposition_id", "base_reference", "source_url", "scrape_status"
    )
