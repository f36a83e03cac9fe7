"""Text functions of retrieval, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracegrove.config import DEFAULT

# Words that make a query a question in natural language.
NL_WORDS = (
    "怎么", "什么", "如何", "为什么", "哪里", "哪些", "哪个",
    "流程", "机制", "原理", "影响", "模块", "功能", "逻辑",
    "启动", "调用", "实现", "过程", "步骤", "作用", "区别", "解释",
    "在哪", "怎样", "分析", "介绍", "说明", "包含", "涉及", "相关",
    "how", "what", "why", "where", "when", "explain", "describe", "find",
)
# Patterns that tell exact queries from questions, in the order of the rules.
EXACT_FIELDS = r"^(sym:|file:|r:|lang:|case:)"
EXACT_REGEX = r'^r".*"$'
CJK = r"[一-鿿]"
MIXED_IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_.]{2,}"
EXACT_WORD = r"^[A-Za-z0-9_./:\-]+$"
LONG_QUERY = 15
# Patterns of keyword rewriting: identifiers, and what is blanked out between words.
IDENTIFIER = r"[a-zA-Z_][a-zA-Z0-9_.]{3,}"
PARTICLES = r"[一-鿿，。？！、的是在了和与或]+"
# Patterns of entity tokens, in their order.
ENTITY_PATTERNS = (r"[A-Z][a-z]+(?:[A-Z][a-z]+)+", r"[a-z]+(?:_[a-z]+)+", r"[a-zA-Z][a-zA-Z0-9]{2,}")
# File suffixes and their languages, first match wins.
LANGUAGES = {
    ".java": "java", ".kt": "kotlin", ".py": "python", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
    ".xml": "xml", ".json": "json", ".mk": "makefile", ".bp": "blueprint", ".aidl": "aidl", ".rs": "rust", ".go": "go",
}
# Suffix and directory bonuses of the reranker.
SUFFIX_BONUS = (((".java",), 0.05), ((".cpp", ".cc", ".h", ".hpp"), 0.03), ((".py",), 0.02))
VALUED_PATHS = ("frameworks/base", "system/core", "system/server")


def strip(c: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def classify_query(query: Column) -> Column:
    """``exact`` or ``natural_language``, by rules in order."""
    q = strip(query)
    exact, natural = F.lit("exact"), F.lit("natural_language")
    words = "|".join(NL_WORDS)
    return (
        F.when(q.rlike(EXACT_FIELDS), exact)
        .when(q.rlike(EXACT_REGEX), exact)
        .when(F.lower(q).rlike(words), natural)
        .when(q.rlike(CJK) & q.rlike(MIXED_IDENTIFIER), natural)
        .when(q.rlike(EXACT_WORD), exact)
        .when(F.char_length(q) > LONG_QUERY, natural)
        .otherwise(exact)
    )


def ascii_words(query: Column) -> Column:
    """What begins with a letter once CJK characters and some particles are blanked out."""
    rest = strip(F.regexp_replace(query, PARTICLES, " "))
    return F.filter(F.split(rest, r"(?U)\s+"), lambda w: w.rlike(r"^[a-zA-Z]"))


def fallback_rewrite(query: Column, limit: int = DEFAULT.rewrite_limit) -> Column:
    """At most ``limit`` queries: identifiers, the words together, adjacent pairs, single words, else the query itself."""
    ids = F.regexp_extract_all(query, F.lit(IDENTIFIER), F.lit(0))
    none = F.array().cast("array<string>")

    def routes(w: Column) -> Column:
        n = F.size(w)
        whole = F.when(n >= 2, F.array(F.array_join(w, " "))).otherwise(none)
        pairs = F.when(n >= 2, F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(none)
        return F.concat(whole, pairs, F.filter(w, lambda x: F.char_length(x) >= 3))

    # the words are bound to a variable, so that they are found once
    of_words = F.element_at(F.transform(F.array(ascii_words(query)), routes), 1)
    cut = F.slice(F.array_distinct(F.concat(ids, of_words)), 1, limit)
    return F.element_at(F.transform(F.array(cut), lambda c: F.when(F.size(c) == 0, F.array(query)).otherwise(c)), 1)


def entity_tokens(query: Column) -> Column:
    """Camel-case, snake-case and other words of three characters or more, lower-cased, in order of first appearance."""
    each = [F.regexp_extract_all(query, F.lit(p), F.lit(0)) for p in ENTITY_PATTERNS]
    return F.array_distinct(F.transform(F.concat(*each), F.lower))


def rerank_tokens(query: Column) -> Column:
    """Distinct words and camel-case parts of two characters or more, sorted."""
    words = F.split(strip(F.lower(query)), r"(?U)\s+")
    camel = F.transform(F.regexp_extract_all(query, F.lit(r"[A-Z][a-z]+"), F.lit(0)), F.lower)
    return F.array_sort(F.array_distinct(F.filter(F.concat(words, camel), lambda t: F.char_length(t) >= 2)))


def hits(tokens: Column, text: Column) -> Column:
    """How many of the tokens occur in the text, which is evaluated once, not for each token."""
    return F.get(F.transform(F.array(text), lambda x: F.size(F.filter(tokens, lambda t: F.contains(x, t)))), F.lit(0))


def suffix_bonus(title: Column) -> Column:
    out = F.lit(0.0)
    for suffixes, bonus in reversed(SUFFIX_BONUS):
        cond = F.lit(False)
        for s in suffixes:
            cond = cond | title.endswith(s)
        out = F.when(cond, bonus).otherwise(out)
    return out


def path_bonus(title: Column) -> Column:
    cond = F.lit(False)
    for p in VALUED_PATHS:
        cond = cond | F.contains(title, F.lit(p))
    return F.when(cond, 0.03).otherwise(0.0)


def with_bonuses(in_title: Column, in_content: Column, title: Column, score: Column, dense: Column, bonus: float = DEFAULT.dense_bonus) -> Column:
    """The fused score plus bonuses for tokens that the lower-cased title and the content hold, suffix, directory and the dense lane, to four places."""
    return F.round(score + 0.15 * in_title + F.least(0.03 * in_content, F.lit(0.15)) + suffix_bonus(title) + path_bonus(title) + F.when(dense, bonus).otherwise(0.0), 4)


def rerank_score(tokens: Column, title: Column, content: Column, score: Column, dense: Column, bonus: float = DEFAULT.dense_bonus) -> Column:
    """The fused score with its bonuses for the tokens of a query."""
    title = F.lower(title)
    return with_bonuses(hits(tokens, title), hits(tokens, F.lower(content)), title, score, dense, bonus)


def sigmoid_score(score: Column, position: Column, total: Column) -> Column:
    """A raw score through a logistic around 10; without a positive one, by position from 1 down to a half."""
    by_place = F.round(1 - position / F.greatest(total, F.lit(1)) * 0.5, 4)
    return F.when(score > 0, F.round(1 / (1 + F.exp(-0.1 * (score - 10))), 4)).otherwise(by_place)


def infer_language(path: Column) -> Column:
    out = None
    for suffix, lang in LANGUAGES.items():
        out = F.when(path.endswith(suffix), lang) if out is None else out.when(path.endswith(suffix), lang)
    return out.otherwise("unknown")


def snippet(matches: Column) -> Column:
    """``L<n>: <fragment>`` lines of array<struct<line_num, fragments array<struct<pre, match, post>>>>; blank ones left out."""
    line = lambda m: strip(F.array_join(F.transform(m["fragments"], lambda f: F.concat(F.coalesce(f["pre"], F.lit("")), F.coalesce(f["match"], F.lit("")), F.coalesce(f["post"], F.lit("")))), ""))
    lines = F.filter(F.transform(matches, lambda m: F.when(line(m) != "", F.concat(F.lit("L"), m["line_num"].cast("string"), F.lit(": "), line(m)))), lambda x: x.isNotNull())
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("(no content preview available)")


def numbered_lines(lines: Column, start: Column, end: Column) -> Column:
    """``L<n>: <line>`` of the lines from ``start`` (1 at least) to ``end`` (0 or null: the last), joined."""
    total = F.size(lines)
    s = F.greatest(start, F.lit(1)) - 1
    e = F.least(F.coalesce(F.nullif(end, F.lit(0)), total), total)
    part = F.when(e > s, F.slice(lines, s + 1, e - s)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.transform(part, lambda x, i: F.concat(F.lit("L"), (i + s + 1).cast("string"), F.lit(": "), x)), "\n")


# Named entities that pages use, the ampersand last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&bull;", "•"), ("&middot;", "·"), ("&times;", "×"), ("&deg;", "°"), ("&euro;", "€"), ("&pound;", "£"),
    ("&sect;", "§"), ("&para;", "¶"), ("&larr;", "←"), ("&rarr;", "→"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"), ("&szlig;", "ß"), ("&eacute;", "é"),
    ("&egrave;", "è"), ("&agrave;", "à"), ("&ccedil;", "ç"), ("&ntilde;", "ñ"), ("&amp;", "&"),
)


def unescape(x: Column) -> Column:
    """Numeric entities, decimal or hexadecimal, and the named ones of ENTITIES as characters; each is resolved once."""
    hexadecimal = lambda e: F.regexp_extract(e, "^&#[xX]([0-9a-fA-F]+);$", 1)
    digits = lambda e: F.when(hexadecimal(e) != "", hexadecimal(e)).otherwise(F.hex(F.regexp_extract(e, "^&#([0-9]+);$", 1).cast("int")))
    char = lambda e: F.decode(F.unhex(F.lpad(digits(e), 8, "0")), "UTF-32")
    # an ampersand that an entity gives is no part of another one: it is kept apart until all are resolved
    held = F.aggregate(
        F.array_distinct(F.regexp_extract_all(x, F.lit("&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0))),
        x,
        lambda text, e: F.replace(text, e, F.when(char(e) == "&", F.lit("\u0001")).otherwise(char(e))),
    )
    for entity, c in ENTITIES:
        held = F.replace(held, F.lit(entity), F.lit("\u0001" if c == "&" else c))
    return F.replace(held, F.lit("\u0001"), F.lit("&"))


def result_title(repo: Column, path: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """repo/path, or the path alone without a repo; with a first line, ``:start-end`` behind it."""
    whole = F.when(F.coalesce(repo, F.lit("")) != "", F.concat_ws("/", repo, path)).otherwise(path)
    if start is None:
        return whole
    return F.when(start.isNotNull(), F.concat(whole, F.lit(":"), start.cast("string"), F.lit("-"), F.coalesce(end, start).cast("string"))).otherwise(whole)


def safe_name(c: Column) -> Column:
    """A path as the name of a log or a shard."""
    return F.translate(c, "/", "_")


def token_count(c: Column) -> Column:
    """Parts between white space."""
    text = strip(F.coalesce(c, F.lit("")))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))


def html_lines(html: Column, tag: str = "pre") -> Column:
    """Text of each <tag> element: line-number spans and tags dropped, entities resolved."""
    found = F.regexp_extract_all(html, F.lit(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1))

    def plain(x: Column) -> Column:
        return unescape(F.regexp_replace(F.regexp_replace(x, r'(?s)<span class="noselect">.*?</span>', ""), r"(?s)<[^>]+>", ""))

    return F.transform(found, plain)


def truncated(value: Column, limit: int = 1024) -> Column:
    """A value of more than ``limit`` bytes as its first ``limit`` characters and dots."""
    return F.when(F.octet_length(value) > limit, F.concat(F.substring(value, 1, limit), F.lit("..."))).otherwise(value)


def json_in_markdown(text: Column) -> Column:
    """The first fenced part that begins with a brace, after an optional ``json`` tag; the stripped text if there is none."""
    parts = F.transform(F.split(text, "```"), lambda p: strip(F.regexp_replace(strip(p), r"^json", "")))
    return F.coalesce(F.get(F.filter(parts, lambda p: p.startswith("{")), F.lit(0)), strip(text))


def cache_key(query: Column) -> Column:
    return F.md5(F.lower(strip(query)))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse_uri(uri: Column) -> Column:
    """scheme, repo and path of scheme://repo/path."""
    p = r"^([a-z]+)://([^/]+)/(.*)$"
    return F.struct(F.regexp_extract(uri, p, 1).alias("scheme"), F.regexp_extract(uri, p, 2).alias("repo"), F.regexp_extract(uri, p, 3).alias("path"))
