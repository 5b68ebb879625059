"""The search engine's registered queries and their DuckDB counterparts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .deploy import is_local
from .engine import Config, Engine, SearchOptions, search_files
from .errors import IndexFailure
from .functions import filetypes, hints, text
from .functions.durations import parse_since
from .operators import context, filters, formats, match, postings
from .plans import trigrams
from .sources import corpus as corpora
from .sources import git
from .sources import index as indexes
from .tools import definition_pattern

#: Extensions that the documents' paths have by turns.
EXTENSIONS = ["rs", "py", "js", "md", "h", "txt"]
ROOT = "/data"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: (path, content, mtime, size, file_id)."""
    docs = read(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id"), F.lit("."), ext)
    rows = docs.select(path.alias("path"), F.col("text").alias("content"), (F.col("doc_id") + 1700000000).alias("mtime"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("file_id"))
    return corpora.text_only(rows)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.from_table(read(spark, sf_dir, "pages"), "url", "html")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as changes (path, ts, commit_id) of the documents, ten to a commit."""
    events = read(spark, sf_dir, "events")
    n = read(spark, sf_dir, "documents").agg(F.max("doc_id").alias("top"))
    ids = events.crossJoin(F.broadcast(n)).select((F.col("event_id") % (F.col("top") + 1)).alias("file_id"), "ts", F.floor(F.col("event_id") / 10).alias("commit_id"))  # n is one row
    return ids.join(documents(spark, sf_dir).select("file_id", "path"), "file_id").select("path", "ts", "commit_id")


CORPUS = f"""corpus AS (
  SELECT doc_id AS file_id, source || '/' || lang || '/doc_' || doc_id || '.' || {EXTENSIONS}[doc_id % 6 + 1] AS path, text AS content, 1700000000 + doc_id AS mtime
  FROM documents WHERE text IS NOT NULL
)"""
LINES = """parts AS (SELECT path, content, string_split(content, chr(10)) AS p FROM corpus),
lines AS (
  SELECT path AS file, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_number, content
  FROM (SELECT path, content, CASE WHEN len(p) > 1 AND p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM parts)
)"""
PAGES = "corpus AS (SELECT url AS path, html AS content FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)"
TRIGRAMS = """grams AS (
  SELECT DISTINCT file_id, substr(h, 2 * i - 1, 6) AS g
  FROM (SELECT file_id, hex(encode(content)) AS h, unnest(range(1, octet_length(encode(content)) - 1)) AS i FROM corpus)
)"""
CHANGES = """n AS (SELECT max(doc_id) + 1 AS n FROM documents),
changes AS (SELECT path, ts, event_id // 10 AS commit_id FROM events, n, corpus WHERE event_id % n = file_id)"""
UP, LOW = text.UPPER, text.LOWER
#: File numbers that a row of a posting list spans.
CHUNK = 512


def found(condition: str, corpus: str = CORPUS, extra: str = "", tail: str = "") -> str:
    return f"WITH {corpus}, {LINES}{extra} SELECT file, line_number, line FROM lines WHERE {condition}{tail}"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with DuckDB SQL for the same rows."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


# Literal and regular search


@query(found("contains(line, 'licen')"))
def literal_search(spark, sf_dir):
    return match.literal(documents(spark, sf_dir), "licen")


@query(found("contains(line, 'example.com')", PAGES))
def literal_search_pages(spark, sf_dir):
    return match.literal(pages(spark, sf_dir), "example.com")


@query(found(f"contains(translate(line, '{UP}', '{LOW}'), 'license') AND content <> ''"))
def literal_ci(spark, sf_dir):
    return match.literal_ignoring_case(documents(spark, sf_dir), "LICENSE")


@query(f"""WITH {CORPUS}, parts AS (SELECT path, string_split(content, chr(10)) AS p FROM corpus),
places AS (SELECT path, p, unnest(range(1, len(p))) AS i FROM parts)
SELECT path AS file, CAST(i AS INTEGER) AS line_number, p[i] AS line FROM places WHERE ends_with(p[i], '.') AND starts_with(p[i + 1], 'Th')""")
def literal_multiline(spark, sf_dir):
    return match.literal(documents(spark, sf_dir), ".\nTh")


@query(found("contains(line, 'Zu')"))
def short_literal_2(spark, sf_dir):
    return match.literal(documents(spark, sf_dir), "Zu")


@query(found("contains(line, '@')"))
def short_literal_1(spark, sf_dir):
    return match.literal(documents(spark, sf_dir), "@")


@query(found("true", "corpus AS (SELECT CAST(item_id AS VARCHAR) AS path, text AS content FROM benchmark WHERE text IS NOT NULL)"))
def empty_pattern(spark, sf_dir):
    return match.literal(corpora.from_table(read(spark, sf_dir, "benchmark"), "item_id", "text"), "")


def _regex(pattern: str, ignore_case: bool = False) -> str:
    p = ("(?i)" if ignore_case else "") + pattern.replace("'", "''")
    return found(f"regexp_matches(line, '{p}') AND regexp_matches(content, '{p}')")


@query(_regex("[Ll]icensed under [A-Za-z ]+"))
def regex_search(spark, sf_dir):
    return match.regular(documents(spark, sf_dir), "[Ll]icensed under [A-Za-z ]+")


@query(_regex("Apache|Public License|idiot"))
def regex_alternation(spark, sf_dir):
    return match.regular(documents(spark, sf_dir), "Apache|Public License|idiot")


@query(_regex("Release.*MIT"))
def regex_concat_gap(spark, sf_dir):
    return match.regular(documents(spark, sf_dir), "Release.*MIT")


@query(_regex("all rights", True))
def regex_ci(spark, sf_dir):
    return match.regular(documents(spark, sf_dir), "all rights", ignore_case=True)


@query(_regex("[0-9]{3}-[0-9]{4}"))
def regex_class(spark, sf_dir):
    return match.regular(documents(spark, sf_dir), "[0-9]{3}-[0-9]{4}")


@query(_regex("^Th[aeiou]"))
def regex_anchor(spark, sf_dir):
    return match.regular(documents(spark, sf_dir), "^Th[aeiou]")


@query(found("regexp_matches(line, '^Licensed')"))
def regex_line_anchor(spark, sf_dir):
    return match.regular(documents(spark, sf_dir), "^Licensed", line_anchors=True)


# Index


@query(f"WITH {CORPUS}, {TRIGRAMS} SELECT file_id, g FROM grams")
def trigram_extract(spark, sf_dir):
    made = postings.extract(documents(spark, sf_dir))
    return made.select("file_id", F.lpad(F.hex("g"), 6, "0").alias("g"))


@query(f"WITH {CORPUS}, {TRIGRAMS} SELECT file_id, g FROM grams")
def trigram_extract_sql(spark, sf_dir):
    return documents(spark, sf_dir).select("file_id", F.explode(postings.trigrams_sql(F.col("content"))).alias("g"))


def _postings(spark, sf_dir):
    return postings.extract(documents(spark, sf_dir))


@query(f"WITH {CORPUS}, {TRIGRAMS} SELECT g, count(*) AS df FROM grams GROUP BY g")
def postings_df(spark, sf_dir):
    return postings.document_frequency(_postings(spark, sf_dir)).select(F.lpad(F.hex("g"), 6, "0").alias("g"), "df")


@query(f"WITH {CORPUS}, {TRIGRAMS} SELECT g, file_id // {CHUNK} AS chunk, array_to_string(list(file_id ORDER BY file_id), ',') AS ids FROM grams GROUP BY g, chunk")
def postings_list(spark, sf_dir):
    """The posting lists in chunks, as a frequent trigram's is no row of a cluster."""
    lists = _postings(spark, sf_dir).groupBy("g", F.floor(F.col("file_id") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("file_id")).alias("ids"))
    return lists.select(F.lpad(F.hex("g"), 6, "0").alias("g"), "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {CORPUS}, {TRIGRAMS} SELECT count(*) AS pairs, count(DISTINCT g) AS trigrams, count(DISTINCT file_id) AS files FROM grams")
def index_stats(spark, sf_dir):
    return _postings(spark, sf_dir).agg(F.count("*").alias("pairs"), F.count_distinct("g").alias("trigrams"), F.count_distinct("file_id").alias("files"))


@query(f"WITH {CORPUS}, {TRIGRAMS} SELECT file_id, g FROM grams WHERE g IN ('6C6963', '4D4954')")
def trigram_lookup(spark, sf_dir):
    return postings.lookup(_postings(spark, sf_dir), [0x6C6963, 0x4D4954]).select("file_id", F.lpad(F.hex("g"), 6, "0").alias("g"))


@query(f"WITH {CORPUS}, {TRIGRAMS} SELECT DISTINCT file_id FROM grams WHERE starts_with(g, '5A75')")
def prefix_lookup(spark, sf_dir):
    return postings.prefix_lookup(_postings(spark, sf_dir), b"Zu")


def _all_of(word: str) -> str:
    grams = sorted({word.encode()[i : i + 3].hex().upper() for i in range(len(word) - 2)})
    return f"SELECT file_id FROM grams WHERE g IN ({', '.join(map(repr, grams))}) GROUP BY file_id HAVING count(*) = {len(grams)}"


@query(f"WITH {CORPUS}, {TRIGRAMS} {_all_of('License')}")
def candidates_and(spark, sf_dir):
    return postings.candidates(_postings(spark, sf_dir), trigrams.literal("License"))


@query(f"WITH {CORPUS}, {TRIGRAMS} {_all_of('Apache')} UNION {_all_of('idiot')}")
def candidates_or(spark, sf_dir):
    return postings.candidates(_postings(spark, sf_dir), trigrams.of_regex("Apache|idiot"))


@query(f"WITH {CORPUS}, {TRIGRAMS}, upper_grams AS (SELECT DISTINCT file_id, hex(encode(translate(try(decode(unhex(g))), '{UP}', '{LOW}'))) AS g FROM grams WHERE regexp_matches(g, '^([2-7][0-9A-F]){{3}}$')) SELECT file_id FROM upper_grams WHERE g IN ('6D6974', '697420') GROUP BY file_id HAVING count(*) = 2")
def candidates_ci(spark, sf_dir):
    return postings.candidates(_postings(spark, sf_dir), trigrams.literal("MIT ", ignore_case=True))


@query(f"""WITH {CORPUS}, {TRIGRAMS}, c AS ({_all_of('licens')})
SELECT count(*) AS candidates, count_if(contains(content, 'licens')) AS matching, count_if(NOT contains(content, 'licens')) AS false_positives FROM c JOIN corpus USING (file_id)""")
def false_positive_rate(spark, sf_dir):
    files = documents(spark, sf_dir)
    hit = F.contains("content", F.lit("licens"))
    left = files.join(postings.candidates(postings.extract(files), trigrams.literal("licens")), "file_id", "left_semi")
    return left.agg(F.count("*").alias("candidates"), F.count_if(hit).alias("matching"), F.count_if(~hit).alias("false_positives"))


def _index_path(spark) -> str:
    """A new path in the folder that the cluster's machines share; without one, a local session's own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not is_local(spark):
            raise IndexFailure("spark.checkpoint.dir has to name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="trisearch-")
    return f"{shared.rstrip('/')}/index-{uuid.uuid4().hex}"


def _engine(spark, sf_dir) -> Engine:
    """The documents with an index of their own."""
    engine = Engine(spark, None, _index_path(spark), documents(spark, sf_dir), Config(quiet=True))
    engine.build_index()
    return engine


@query(found("contains(line, 'rights reserved')"))
def literal_indexed(spark, sf_dir):
    return _engine(spark, sf_dir).search("rights reserved")


@query(found(f"contains(translate(line, '{UP}', '{LOW}'), 'apache li') AND content <> ''"))
def literal_ci_indexed(spark, sf_dir):
    return _engine(spark, sf_dir).search("Apache LI", SearchOptions(case_insensitive=True))


@query(found("contains(line, 'Zu')"))
def short_indexed(spark, sf_dir):
    """Two bytes, which the index looks up as a range."""
    return _engine(spark, sf_dir).search("Zu")


@query(_regex("Apache|Public License|idiot"))
def regex_indexed(spark, sf_dir):
    return _engine(spark, sf_dir).search("Apache|Public License|idiot", SearchOptions(regex=True))


@query(found("contains(line, 'License') AND ends_with(file, '.py') AND contains(file, 'src1')", tail=" ORDER BY file, line_number LIMIT 5"))
def options_indexed(spark, sf_dir):
    return _engine(spark, sf_dir).search("License", SearchOptions(file_type="py", path_pattern="src1", max_count=5))


@query(f"WITH {CORPUS} SELECT count(*) AS files, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM corpus")
def index_meta(spark, sf_dir):
    meta = indexes.build(documents(spark, sf_dir), _index_path(spark)).meta
    return spark.createDataFrame([(meta["file_count"], meta["bytes"])], "files long, bytes long")


@query(f"""WITH {CORPUS} SELECT path, CASE WHEN file_id % 3 = 1 THEN 'changed' ELSE 'kept' END AS state, md5(content || CASE WHEN file_id % 3 = 1 THEN ' changed' ELSE '' END) AS content_hash FROM corpus WHERE file_id % 3 <> 2""")
def incremental_build(spark, sf_dir):
    """Of an index two thirds are left, half of these changed: what a second build keeps and reads anew."""
    path, files = _index_path(spark), documents(spark, sf_dir)
    first = indexes.build(files, path)
    changed = F.col("file_id") % 3 == 1
    content = F.when(changed, F.concat("content", F.lit(" changed"))).otherwise(F.col("content"))
    later = files.where("file_id % 3 <> 2").select("path", content.alias("content"), F.when(changed, F.col("mtime") + 60).otherwise(F.col("mtime")).alias("mtime"), F.octet_length(content).cast("long").alias("size"))
    second = indexes.build(later, path)
    return second.files.select("path", F.when(F.col("build") > first.meta["build"], "changed").otherwise("kept").alias("state"), "content_hash")


@query(f"WITH {CORPUS} SELECT path, md5(content) AS content_hash FROM corpus")
def content_hash(spark, sf_dir):
    return documents(spark, sf_dir).select("path", F.md5(F.col("content").cast("binary")).alias("content_hash"))


@query(f"WITH {CORPUS} SELECT path FROM corpus WHERE file_id % 7 <> 0")
def binary_filter(spark, sf_dir):
    """A zero byte is put into every seventh file, which makes it binary."""
    files = documents(spark, sf_dir)
    marked = files.withColumn("content", F.when(F.col("file_id") % 7 == 0, F.concat("content", F.lit("\0"))).otherwise(F.col("content")))
    return corpora.text_only(marked).select("path")


# Filters and limits


@query(found("contains(line, 'the') AND ends_with(file, '.py')"))
def filter_type(spark, sf_dir):
    return search_files(documents(spark, sf_dir), "the", SearchOptions(file_type="Python"))


@query(found("contains(line, 'der') AND contains(file, 'src1/')"))
def filter_path(spark, sf_dir):
    return search_files(documents(spark, sf_dir), "der", SearchOptions(path_pattern="src1/"))


@query(found("contains(line, 'License') AND NOT contains(file, 'src1') AND NOT contains(file, '/de/')"))
def filter_exclude(spark, sf_dir):
    return filters.without(match.literal(documents(spark, sf_dir), "License"), "file", ["src1", "", "/de/"])


@query(found("contains(line, 'the')", tail=" ORDER BY file, line_number LIMIT 25"))
def max_count(spark, sf_dir):
    return search_files(documents(spark, sf_dir), "the", SearchOptions(max_count=25))


@query(f"WITH {CORPUS}, {LINES}, f AS (SELECT file, line_number, line FROM lines WHERE contains(line, 'the') ORDER BY file, line_number LIMIT 200) SELECT * FROM f WHERE NOT contains(file, '.js')")
def exclude_after_limit(spark, sf_dir):
    return filters.without(search_files(documents(spark, sf_dir), "the", SearchOptions(max_count=200)), "file", [".js"])


@query(f"WITH {CORPUS} SELECT path FROM corpus WHERE path GLOB 'src1*/en/*.rs'")
def find_glob(spark, sf_dir):
    return filters.by_name(documents(spark, sf_dir).select("path"), "src1*/en/*.rs").orderBy("path")


@query(f"WITH {CORPUS} SELECT path FROM corpus WHERE contains(lower(path), 'doc_12')")
def find_substring(spark, sf_dir):
    return filters.by_name(documents(spark, sf_dir).select("path"), "DOC_12").orderBy("path")


@query(f"WITH {CORPUS} SELECT path FROM corpus WHERE contains(path, 'src') AND ends_with(path, '.md') AND NOT contains(path, '/en/') ORDER BY path LIMIT 20")
def find_type_exclude_limit(spark, sf_dir):
    named = filters.by_name(documents(spark, sf_dir).select("path"), "src")
    kept = filters.without(named.where(filters.of_type(F.col("path"), "md")), "path", ["/en/"])
    return kept.orderBy("path").limit(20)


# Output


LICENSE = "contains(line, 'License')"


@query(f"WITH {CORPUS}, {LINES} SELECT file, count(*) AS n FROM lines WHERE {LICENSE} GROUP BY file")
def count_per_file(spark, sf_dir):
    return formats.count_per_file(match.literal(documents(spark, sf_dir), "License"))


@query(f"WITH {CORPUS}, {LINES} SELECT DISTINCT file FROM lines WHERE {LICENSE}")
def files_only(spark, sf_dir):
    return formats.files_only(match.literal(documents(spark, sf_dir), "License"))


@query(f"WITH {CORPUS}, {LINES}, f AS (SELECT file FROM lines WHERE {LICENSE} ORDER BY file, line_number LIMIT 20) SELECT count(*) AS matches, count(DISTINCT file) AS files, count(*) = 20 AS limited, CASE WHEN count(*) = 20 THEN format('Found {{}}+ matches in {{}} files (limited to 20)', count(*), count(DISTINCT file)) ELSE format('Found {{}} matches in {{}} files', count(*), count(DISTINCT file)) END AS header FROM f")
def match_summary(spark, sf_dir):
    return formats.summary(search_files(documents(spark, sf_dir), "License", SearchOptions(max_count=20)), 20)


@query(f"WITH {CORPUS}, {LINES} SELECT file, line_number, '{ROOT}/' || file || ':' || line_number || ':' || line AS text FROM lines WHERE {LICENSE}")
def format_default(spark, sf_dir):
    return formats.default_lines(match.literal(documents(spark, sf_dir), "License"), ROOT)


@query(f"WITH {CORPUS}, {LINES} SELECT file, line_number, CAST(json_object('file', file, 'line_number', line_number, 'line', line) AS VARCHAR) AS text FROM lines WHERE {LICENSE}")
def format_json(spark, sf_dir):
    return formats.json_rows(match.literal(documents(spark, sf_dir), "License"))


RANGES = f"""tl AS (SELECT path, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS l FROM parts),
m AS (SELECT file, line_number, len(l) AS total FROM lines JOIN tl ON path = file WHERE {LICENSE}),
near AS (SELECT file, line_number, greatest(line_number - 2, 1) AS s, least(line_number + 2, total) AS e FROM m),
flag AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY file ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS b FROM near),
isl AS (SELECT *, CAST(sum(b) OVER (PARTITION BY file ORDER BY line_number) AS INTEGER) AS island FROM flag),
ranges AS (SELECT file, island, CAST(min(s) AS INTEGER) AS "start", CAST(max(e) AS INTEGER) AS "end", count(*) AS n_matches FROM isl GROUP BY file, island)"""
INSIDE = """inside AS (
  SELECT r.file, r.island, CAST(i AS INTEGER) AS line_number, l[i] AS line, EXISTS (SELECT 1 FROM m WHERE m.file = r.file AND m.line_number = i) AS is_match
  FROM (SELECT *, unnest(range("start", "end" + 1)) AS i FROM ranges) r JOIN tl ON tl.path = r.file)"""


@query(f'WITH {CORPUS}, {LINES}, {RANGES} SELECT file, island, "start", "end", n_matches FROM ranges')
def context_ranges(spark, sf_dir):
    files = documents(spark, sf_dir)
    return context.ranges(match.literal(files, "License"), files, 2)


@query(f"WITH {CORPUS}, {LINES}, {RANGES}, {INSIDE} SELECT * FROM inside")
def context_lines(spark, sf_dir):
    files = documents(spark, sf_dir)
    return context.lines(match.literal(files, "License"), files, 2)


@query(f"WITH {CORPUS}, {LINES}, {RANGES}, {INSIDE} SELECT file, island, regexp_replace(string_agg(file || CASE WHEN is_match THEN ':' ELSE '-' END || line_number || CASE WHEN is_match THEN ':' ELSE '-' END || line, chr(10) ORDER BY line_number), '\\s+$', '') AS text FROM inside GROUP BY file, island")
def format_context(spark, sf_dir):
    files = documents(spark, sf_dir)
    return formats.context_blocks(match.literal(files, "License"), files, 2)


LANG = "CASE regexp_extract(file, '\\.([^./]*)$', 1) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'md' THEN 'markdown' WHEN 'h' THEN 'c' ELSE '' END"
BLOCKS = f"""blocks AS (SELECT file, island, '## ' || file || ':' || CASE WHEN min(line_number) = max(line_number) THEN CAST(min(line_number) AS VARCHAR) ELSE min(line_number) || '-' || max(line_number) END
  || chr(10) || chr(10) || '```' || {LANG} || chr(10) || string_agg(line || chr(10), '' ORDER BY line_number) || '```' || chr(10) AS text FROM inside GROUP BY file, island)"""


@query(f"WITH {CORPUS}, {LINES}, {RANGES}, {INSIDE}, {BLOCKS} SELECT file, island, text FROM blocks")
def format_llm(spark, sf_dir):
    files = documents(spark, sf_dir)
    return formats.markdown_blocks(match.literal(files, "License"), files, 2)


@query(f"""WITH {CORPUS}, a AS (SELECT path, strlen(regexp_replace(content, '[^\\x00-\\x7F]', '', 'g')) AS plain, strlen(content) AS size FROM corpus)
SELECT path, CAST(plain // 4 + (size - plain) // 2 + 1 AS BIGINT) AS tokens FROM a""")
def token_estimate(spark, sf_dir):
    files = documents(spark, sf_dir)
    plain = text.ascii_bytes(F.col("content"))
    return files.select("path", text.token_estimate(plain, F.octet_length("content") - plain).cast("long").alias("tokens"))


@query(f"""WITH {CORPUS}, {LINES}, {RANGES}, {INSIDE}, {BLOCKS},
whole AS (SELECT file, string_agg(text, chr(10) ORDER BY island) AS text FROM blocks GROUP BY file),
sized AS (SELECT file, text, strlen(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS plain, strlen(text) AS size, row_number() OVER (ORDER BY file) AS k FROM whole),
est AS (SELECT file, text, sum(plain + CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (ORDER BY file) // 4 + sum(size - plain) OVER (ORDER BY file) // 2 + 1 AS estimate,
  coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS more_matches, count(*) OVER (ORDER BY file ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS more_files
  FROM sized JOIN (SELECT file, count(*) AS n FROM m GROUP BY file) USING (file)),
b AS (SELECT *, coalesce(lag(estimate) OVER (ORDER BY file), 0) AS before FROM est)
SELECT file, text, CAST(estimate AS BIGINT) AS estimate, CAST(more_matches AS BIGINT) AS more_matches, more_files FROM b WHERE before < 4000""")
def token_budget(spark, sf_dir):
    files = documents(spark, sf_dir)
    hits = match.literal(files, "License")
    return formats.within_budget(formats.markdown_blocks(hits, files, 2), hits, 4000)


@query(f"WITH {CORPUS}, {LINES} SELECT line_number, lpad(CAST(line_number AS VARCHAR), 4, ' ') || ' | ' || line AS text FROM lines WHERE file = (SELECT min(path) FROM corpus) AND line_number BETWEEN 2 AND 12")
def read_file_range(spark, sf_dir):
    files = documents(spark, sf_dir)
    first = files.agg(F.min("path").alias("path"))
    lines = match.all_lines(files.join(F.broadcast(first), "path", "left_semi"))  # one row
    return formats.numbered(lines.where(F.col("line_number").between(2, 12)))


@query(found("regexp_matches(line, '(?:pub[ \\t]+)?(?:fn|struct|enum|trait|type|impl|class|def|function|func|fun|const|let|var|val|interface)[ \\t]+track\\b') OR regexp_matches(line, 'var[ \\t]+t\\b')", PAGES))
def find_definitions(spark, sf_dir):
    files = pages(spark, sf_dir)
    return match.regular(files, "|".join(map(definition_pattern, ("track", "t"))))


# Changes


@query(f"WITH {CORPUS}, {LINES}, {CHANGES} SELECT file, line_number, line FROM lines WHERE contains(line, 'License') AND file IN (SELECT path FROM changes)")
def changed_search(spark, sf_dir):
    files = documents(spark, sf_dir).join(git.changed_paths(changes(spark, sf_dir)), "path", "left_semi")
    return match.literal(files, "License")


@query(f"WITH {CORPUS}, {CHANGES} SELECT DISTINCT path FROM changes WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def since_duration(spark, sf_dir):
    now = read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return git.changes_since(changes(spark, sf_dir), "2h", F.lit(now))


@query(f"WITH {CORPUS}, {CHANGES}, c AS (SELECT commit_id FROM changes GROUP BY commit_id ORDER BY max(ts) DESC, commit_id DESC LIMIT 3) SELECT DISTINCT path FROM changes WHERE commit_id IN (SELECT commit_id FROM c)")
def since_commits(spark, sf_dir):
    return git.changes_since(changes(spark, sf_dir), "3.commits", None)


@query(f"WITH {CORPUS}, {LINES}, {CHANGES}, last AS (SELECT DISTINCT path FROM changes WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) SELECT file, line_number, CASE WHEN file IN (SELECT path FROM last) AND line_number = 1 THEN '* ' || line ELSE line END AS line FROM lines WHERE contains(line, 'License')")
def hybrid_search(spark, sf_dir):
    """An index's results, with those of changed files (a mark before their texts) in place of theirs."""
    files = documents(spark, sf_dir)
    now = read(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    changed = git.changes_since(changes(spark, sf_dir), "1d", F.lit(now))
    edited = files.join(changed, "path", "left_semi").withColumn("content", F.concat(F.lit("* "), "content"))
    return filters.merge_fresh(match.literal(files, "License"), match.literal(edited, "License"), changed)


# Catalogues and planning


#: The types' names and extensions.
TYPES = """
c c,h
cpp cpp,cc,cxx,hpp,hxx,h
css css
dart dart
elixir ex,exs
go go
gradle gradle
haskell hs
html html,htm
java java
javascript js,mjs,cjs
json json
jsx jsx
kotlin kt,kts
lua lua
markdown md,markdown
php php
proto proto
python py,pyi
r r,R
ruby rb
rust rs
scala scala,sc
shell sh,bash,zsh
sql sql
svelte svelte
swift swift
terraform tf,tfvars
toml toml
typescript ts,tsx,mts
vue vue
xml xml
yaml yaml,yml
zig zig
"""


@query(f"""WITH l AS (SELECT unnest(string_split(trim('{TYPES}', chr(10)), chr(10))) AS l), t AS (SELECT string_split(l, ' ')[1] AS name, string_split(l, ' ')[2] AS extensions FROM l)
SELECT name, extensions, rpad(name, 14, ' ') || '*.' || replace(extensions, ',', ', *.') AS listing FROM t""")
def type_catalog(spark, sf_dir):
    return filetypes.type_catalog(spark)


@query(f"WITH {CORPUS} SELECT path AS file, {LANG.replace('(file', '(path')} AS language FROM corpus")
def lang_tag(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("path").alias("file"), filetypes.language(F.col("path")).alias("language"))


HINTS = [(r"foo\|bar", r"\|"), ("(foo|bar)", "(foo|bar)"), (r"\d+", r"\d"), (r"\(x\)", r"\("), ("[a-z]", "[a-z]"), ("a{2,3}", "{2,3}"), ("(?=x)", "(?="), (r"a\nb", r"\n"), ("plain", None), (r"\\d", None), ("a|b", None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', {repr(h) if h and chr(92) not in h else (chr(39) + h + chr(39) if h else 'NULL')})" for p, h in HINTS) + ") AS t(pattern, found)")
def hint_detect(spark, sf_dir):
    return spark.createDataFrame([(p, hints.detect_regex(p)) for p, _ in HINTS], "pattern string, found string")


PLANS = [("hello", "and(656C6C,68656C,6C6C6F)"), ("foo|bar", "or(626172,666F6F)"), ("foo.*bar", "and(626172,666F6F)"), ("ab", "all"), (".*", "all"), ("(a|bc)d", "all"), (".+error", "and(657272,726F72,72726F)"), ("a{3}", "616161")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{q}')" for p, q in PLANS) + ") AS t(pattern, plan)")
def regex_plan(spark, sf_dir):
    return spark.createDataFrame([(p, str(trigrams.of_regex(p))) for p, _ in PLANS], "pattern string, plan string")


SPANS = [("1h", "1 hour ago", None), ("30m", "30 minutes ago", None), ("2d", "2 days ago", None), ("1w", "1 week ago", None), ("3.commits", None, 3)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {chr(39) + p + chr(39) if p else 'NULL'}, CAST({n or 'NULL'} AS BIGINT))" for t, p, n in SPANS) + ") AS t(duration, phrase, commits)")
def duration_parse(spark, sf_dir):
    rows = [(t, parse_since(t).phrase, parse_since(t).commits) for t, _, _ in SPANS]
    return spark.createDataFrame(rows, "duration string, phrase string, commits long")


@query(f"WITH {CORPUS} SELECT max(mtime) AS newest, count(*) AS files FROM corpus")
def corpus_newest(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.max("mtime").alias("newest"), F.count("*").alias("files"))
