"""More of the library's operators over the driver's tables: paths, remotes, people, trees and runs, and code made of known pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens import config
from quarrylens.functions import text as X
from quarrylens.operators import access, changes, identities, lines, mirrors, renames, sampling
from quarrylens.plans.proxies import query
from quarrylens.sources import sinks
from quarrylens.sources.tables import table


def _pick(values: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _picked(values: tuple[str, ...], k: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{k} % {len(values)} + 1]"


# ---------------------------------------------------------------- lines and paths

_LANGS = ("PYTHON", "JAVA", "JAVASCRIPT", "UNKNOWN")
_LINES = ("import a.b", "from x import y", "package co.x;", "const a = require ( './b' )", "return importer;", "'use strict';", "} from './x'", "export default a", "importing = 1", "let { a, b } = require('c');", "require('d')", "from")
_INDENTS = ("", "  ", "\t", " \t ", "    ")


@query(
    f"""with l as (select p_partkey as k, {_picked(_LANGS, "p_partkey")} as lang, {_picked(_LINES, "(p_partkey // 4)")} as line, ['', '  ', chr(9), ' ' || chr(9) || ' ', '    '][p_partkey % 5 + 1] as head from part)
select k, lang, case lang when 'PYTHON' then regexp_matches(line, '^(import|from)\\s+\\S') when 'JAVA' then regexp_matches(line, '^(package|import)\\s+\\S')
  when 'JAVASCRIPT' then regexp_matches(line, '^(import|export)\\s') or regexp_matches(line, '^(const|let|var)\\s+[\\w{{}}$,\\s]+=\\s*require\\s*\\(') or regexp_matches(line, '^require\\s*\\(') or line in ('''use strict'';', '''use client''') or regexp_matches(line, '^\\}}?\\s*from\\s+''') else false end as declaration,
 (length(head) + 3 * length(regexp_replace(head, '[^\\t]', '', 'g')))::int as indent from l""".replace("\\\\", "\\")
)
def declared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(k.alias("k"), _pick(_LANGS, k).alias("lang"), _pick(_LINES, F.floor(k / 4)).alias("line"), _pick(_INDENTS, k).alias("head"))
    return own.select("k", "lang", X.is_declaration(F.col("line"), F.col("lang")).alias("declaration"), X.indent(F.concat("head", "line")).alias("indent"))


_FOLDERS = ("", "src/", "vendor/", "a/node_modules/b/", "tests/", "src/test/java/", "docs_src/x/", "lib/es/", "es5/", "core/Profile/", "x/playgrounds/", "builder/", "out/", "a/b/c/", "my.generated.d/", "sample/")
_FILES = ("a.py", "Main.java", "app.ts", "lib.min.js", "test_a.py", "a_test.py", "contest.py", "ParserTest.java", "FooIT.java", "x.spec.tsx", "conftest.py", "y.generated.ts", "model_pb2.py", "README.md", "noext", "Z.PY", "a_generated.py", "b-min.js")


def _excluded_sql() -> str:
    """The default globs as prefixes and patterns of names."""
    folders = [g[3:-3] for g in config.DEFAULT_EXCLUDES if g.endswith("/**")]
    names = [g[3:] for g in config.DEFAULT_EXCLUDES if not g.endswith("/**")]
    inside = " or ".join(f"contains('/' || path, '/{f}/')" for f in folders)
    return f"({inside} or " + " or ".join(f"name glob '{n}'" for n in names) + ")"


@query(
    f"""with p as (select p_partkey as k, {_picked(_FOLDERS, "p_partkey")} || {_picked(_FILES, "(p_partkey // 16)")} as path from part), n as (select *, split_part(path, '/', -1) as name, lower(split_part(path, '.', -1)) as ext from p)
select k, path, {_excluded_sql()} as excluded, contains(path, '.') and ext in ('py', 'pyi', 'java', 'js', 'jsx', 'mjs', 'cjs', 'ts', 'tsx') and not {_excluded_sql()} as relevant from n"""
)
def relevant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(k.alias("k"), F.concat(_pick(_FOLDERS, k), _pick(_FILES, F.floor(k / 16))).alias("path"))
    return own.select("k", "path", X.is_excluded(F.col("path")).alias("excluded"), X.is_relevant(F.col("path")).alias("relevant"))


@query("""with p as (select page_id, regexp_extract(regexp_extract(url, '://(.*)$', 1), '^[^?#]*', 0) as path from pages), f as (select path, split_part(path, '/', -1) as name, split_part(path, '/', 1) as host from p),
e as (select host, case when contains(name, '.') then lower(split_part(name, '.', -1)) else '' end as extension, count(*) as files from f group by all)
select host, extension, files from (select *, row_number() over (partition by host order by files desc, extension) as r from e) where r = 1""")
def top_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract(F.regexp_extract("url", "://(.*)$", 1), r"^[^?#]*", 0)
    own = table(spark, sf_dir, "pages").select(path.alias("path"), F.substring_index(path, "/", 1).alias("host"))
    return lines.dominant_extension(own, ["host"])


@query("""with f as (select distinct regexp_extract(regexp_extract(url, '://(.*)$', 1), '^[^?#]*', 0) as path from pages), d as (select path, string_split(path, '/') as parts from f),
r as (select distinct array_to_string(parts[1:n], '/') as root from d, (select unnest(range(1, 12)) as n) where n < len(parts))
select root, count(*) as files from r join f on starts_with(path, root || '/') group by root""")
def folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "pages").select(F.lit(1).alias("repo_id"), F.regexp_extract(F.regexp_extract("url", "://(.*)$", 1), r"^[^?#]*", 0).alias("path")).distinct()
    return mirrors.under_roots(own, ["repo_id"]).groupBy("root").agg(F.count("*").alias("files"))


# ---------------------------------------------------------------- remotes

_REMOTES = ("https://h.com/a/b.git", "git@h.com:a/b.git/", "ssh://git@h.com/a/b", "ssh://git:pw@h.com/a", "https://user:pw@h.com/a/b/", "https://tok@h.com/x", "http://h.com/a", "ftp://h.com/a", "", "https://localhost/a", "ssh://git@127.0.0.1/a", "https://169.254.7.7/a", "https://[::1]/a", "git@localhost:a/b", "https://230.1.1.1/a", "https://a.localhost/x")


@query(
    rf"""with r as (select s_suppkey as k, {_picked(_REMOTES, "s_suppkey")} as u from supplier), h as (select k, u, regexp_extract(u, '^\w+://([^/@]*)@', 1) as given, lower(case when starts_with(u, 'git@') then split_part(split_part(u, '@', 2), ':', 1) else regexp_extract(regexp_replace(u, '^(\w+://)[^/@]*@', '\1'), '^\w+://(\[[^\]]*\]|[^/:]*)', 1) end) as host from r)
select k, case when u = '' then 'empty' when not (starts_with(u, 'git@') or starts_with(u, 'https://') or starts_with(u, 'ssh://')) then 'scheme' when host in ('localhost', '127.0.0.1', '169.254.7.7', '[::1]', '230.1.1.1', 'a.localhost') then 'host' end as error,
 case when starts_with(u, 'http') then regexp_replace(u, '^(\w+://)[^/@]*@', '\1') else regexp_replace(u, '^(ssh://[^/@:]*):[^/@]*@', '\1@') end as remote, case when starts_with(u, 'http') and not contains(given, ':') then null when given <> '' then split_part(given, ':', 1) end as "user",
 case when contains(given, ':') then split_part(given, ':', 2) when starts_with(u, 'http') and given <> '' then given end as secret,
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '\.git/*$', ''), '^(ssh://)?\w+(:[^/@]*)?@([^:/]+)[:/](.*)$', 'https://\3/\4'), '^(\w+://)[^/@]*@', '\1'), '/+$', '') as browse from h"""
)
def remote_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _pick(_REMOTES, F.col("s_suppkey"))
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), u.alias("u"))
    return own.select("k", X.remote_error(F.col("u")).alias("error"), X.remote_parts(F.col("u")).alias("p"), X.browse_base(F.col("u")).alias("browse")).select("k", "error", "p.remote", "p.user", "p.secret", "browse")


@query("""with p as (select page_id, 'src/a b/' || page_id || '#1.py' as path, url, html from pages)
select page_id, 'https://h/r/blob/feature/x%20y/src/a%20b/' || page_id || '%231.py#L' || (page_id % 90) as link, substr(sha1(url), 1, 8) as short, substr(html, 1, 400) as subject from p""")
def permalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.concat(F.lit("src/a b/"), k.cast("string"), F.lit("#1.py"))
    link = X.permalink(F.lit("https://h/r"), F.lit("feature/x y"), path, k % 90)
    return table(spark, sf_dir, "pages").select("page_id", link.alias("link"), X.short_sha(F.sha1(F.col("url").cast("binary"))).alias("short"), X.short_subject(F.col("html")).alias("subject"))


_SUPPLIERS = "s as (select s_suppkey as repo_id, s_name as name, 'https://Host/Team' || s_nationkey || '/' || replace(s_name, '#', '-') || '.git' as url from supplier)"
_SELECTED = "w as (select distinct lower(trim(x)) as ref from (select unnest(string_split(case o_orderkey % 4 when 0 then 'Supplier#' || lpad((o_custkey % 300)::varchar, 9, '0') when 1 then 'team' || (o_custkey % 25) || '/supplier-' || lpad((o_custkey % 300)::varchar, 9, '0') when 2 then (o_custkey % 400) || ', nobody' || (o_custkey % 20) else '' end, ',')) as x from orders) where trim(x) <> '')"
_FORMS = "c as (select repo_id, unnest([repo_id::varchar, lower(name), lower(url[:-5]), lower(split_part(url[:-5], '/', -2) || '/' || split_part(url[:-5], '/', -1)), lower(split_part(url[:-5], '/', -1))]) as ref from s)"


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    name = F.col("s_name")
    repos = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("repo_id"), name.alias("name"), F.concat(F.lit("https://Host/Team"), F.col("s_nationkey").cast("string"), F.lit("/"), F.replace(name, F.lit("#"), F.lit("-")), F.lit(".git")).alias("url"))
    k, u = F.col("o_orderkey") % 4, F.col("o_custkey")
    number = F.lpad((u % 300).cast("string"), 9, "0")
    text = F.when(k == 0, F.concat(F.lit("Supplier#"), number)).when(k == 1, F.concat(F.lit("team"), (u % 25).cast("string"), F.lit("/supplier-"), number)).when(k == 2, F.concat((u % 400).cast("string"), F.lit(", nobody"), (u % 20).cast("string"))).otherwise("")
    return repos, table(spark, sf_dir, "orders").select(text.alias("selection")).distinct()


@query(f"with {_SUPPLIERS}, {_SELECTED}, {_FORMS} select distinct repo_id, ref from c join w using (ref)")
def named_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.matched(*_references(spark, sf_dir))


@query(f"with {_SUPPLIERS}, {_SELECTED}, {_FORMS} select ref from w where ref not in (select ref from c)")
def unresolved_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.unresolved(*_references(spark, sf_dir))


# ---------------------------------------------------------------- people

_COMMITS = "c as (select c_nationkey as repo_id, c_custkey as idx, 'N' || (c_custkey % 30) as author_name, case when c_custkey % 8 = 0 then '' else 'P' || (c_custkey % 40) || '@X.org' end as author_email from customer)"


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    mail = F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("P"), (k % 40).cast("string"), F.lit("@X.org")))
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo_id"), k.alias("idx"), F.concat(F.lit("N"), (k % 30).cast("string")).alias("author_name"), mail.alias("author_email"), F.lit(1).alias("added"))


@query(f"""with {_COMMITS}, k as (select *, case when author_email = '' then 'name:' || lower(author_name) when repo_id % 2 = 0 and author_email in ('P1@X.org', 'P2@X.org') then 'boss@x.org' else lower(author_email) end as author_key from c),
s as (select *, case when repo_id % 2 = 0 and author_key = 'boss@x.org' then 'The Boss' when repo_id % 2 = 0 and author_key = 'p3@x.org' then 'Three' else author_name end as shown from k)
select repo_id, author_key, arg_min(shown, idx) as name, count(*) as commits, count(distinct author_name || '|' || author_email) as identities from s group by repo_id, author_key""")
def mapped_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits under mail maps: two mails of every other repository are one person's, and a third has another name."""
    own = _commits(spark, sf_dir)
    text = "# people\nThe Boss <Boss@x.org> <p1@x.org>\nThe Boss <boss@x.org> Someone <P2@X.ORG> # note\nThree <p3@x.org>\nnonsense"
    maps = own.filter("repo_id % 2 = 0").select("repo_id").distinct().withColumn("content", F.lit(text))
    out = identities.rollup(identities.keyed(own, identities.mailmap(maps)), ["repo_id"])
    return out.select("repo_id", "author_key", "name", "commits", F.size("identities").cast("long").alias("identities"))


@query(f"with {_COMMITS} select repo_id, count(distinct author_name || '|' || author_email) as raw_identities from c group by repo_id")
def raw_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identities.raw_identities(_commits(spark, sf_dir), ["repo_id"])


# ---------------------------------------------------------------- histories, trees and runs


@query("""with recursive c as (select o_custkey as repo_id, 'c' || o_orderkey as sha, case when o_orderkey % 37 = 0 then null else lag('c' || o_orderkey) over (partition by o_custkey order by o_orderkey) end as parent from orders),
w as (select repo_id, max(o_orderkey) as k from (select o_custkey as repo_id, o_orderkey from orders) group by repo_id), walk as (select repo_id, 'c' || k as sha, 0 as dist from w union all select walk.repo_id, c.parent, dist + 1 from walk join c using (repo_id, sha) where c.parent is not null),
n as (select *, count(*) over (partition by repo_id) as n from walk)
select repo_id, sha, (row_number() over (partition by repo_id order by dist desc) - 1)::int as idx, n > 12 as truncated from n where dist < 12""")
def first_parent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a history, cut where a number is divisible by 37, and its newest twelve commits."""
    from pyspark.sql.window import Window

    sha = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))
    own = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo_id"), "o_orderkey", sha.alias("sha"), F.when(F.col("o_orderkey") % 37 != 0, F.lag(sha).over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).alias("parent_sha"))
    head = own.groupBy("repo_id").agg(F.max_by("sha", "o_orderkey").alias("sha"))
    return sampling.chain(own, head, 12).select("repo_id", "sha", "idx", "truncated")


# parts as paths whose blobs change with the order of their lines
_TREES = "f as (select l_returnflag as repo_id, 'p' || l_partkey as path, 'b' || (l_suppkey % 37) as blob, l_linenumber as valid_from, lead(l_linenumber) over (partition by l_returnflag, l_partkey order by l_linenumber) as valid_to from (select l_returnflag, l_partkey, l_linenumber, min(l_suppkey) as l_suppkey from lineitem group by all))"


def _trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    own = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_partkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    until = F.lead("l_linenumber").over(Window.partitionBy("l_returnflag", "l_partkey").orderBy("l_linenumber"))
    return own.select(F.col("l_returnflag").alias("repo_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.concat(F.lit("b"), (F.col("s") % 37).cast("string")).alias("blob_id"), F.col("l_linenumber").alias("valid_from"), until.alias("valid_to"))


@query(f"""with {_TREES}, a as (select unnest([2, 4, 7]) as idx), v as (select 'b' || k as blob, k % 9 as loc, k % 4 as norm, k as calls, k % 5 as functions from (select unnest(range(37)) as k))
select repo_id, idx, count(*) filter (where loc > 0) as files, sum(loc)::bigint as loc, sum(norm)::bigint as norm_lines, sum(calls)::bigint as calls, sum(functions)::bigint as functions from f join v using (blob) join a on valid_from <= idx and (valid_to is null or idx < valid_to) group by repo_id, idx""")
def tree_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of blobs summed over the trees of three commits."""
    trees = _trees(spark, sf_dir)
    k = F.col("id")
    line = F.struct(F.lit(1).alias("line_no"), F.lit("x").alias("text"))
    zero = {c: F.lit(0) for c in ("comment_lines", "total_lines", "bare", "broad", "swallow", "suppress", "function_lines", "decisions")}
    views = spark.range(37).select(F.concat(F.lit("b"), k.cast("string")).alias("blob_id"), F.array_repeat(line, (k % 9).cast("int")).alias("code"), F.array_repeat(line, (k % 4).cast("int")).alias("norm"), k.alias("calls"), (k % 5).alias("functions"), *[v.alias(c) for c, v in zero.items()])
    at = trees.select("repo_id").distinct().withColumn("idx", F.explode(F.array(F.lit(2), F.lit(4), F.lit(7))))
    return lines.tree_totals(trees, views, at).select("repo_id", "idx", "files", "loc", "norm_lines", "calls", "functions")


@query(f"""with {_TREES}, e as (select repo_id, valid_to as idx, path, blob as old_blob from f where valid_to is not null and valid_to <> 5), b as (select repo_id, valid_from as idx, path, blob as new_blob from f where valid_from <> 3),
x as (select repo_id, idx, e.path as old_path, b.path as new_path, old_blob, new_blob from e full join b using (repo_id, idx, path) where old_blob is distinct from new_blob),
g as (select *, row_number() over (partition by repo_id, idx, old_blob order by old_path) as k from x where new_blob is null), c as (select *, row_number() over (partition by repo_id, idx, new_blob order by new_path) as k from x where old_blob is null),
m as (select coalesce(g.repo_id, c.repo_id) as repo_id, coalesce(g.idx, c.idx) as idx, g.old_path, c.new_path, g.old_blob, c.new_blob from g full join c on g.repo_id = c.repo_id and g.idx = c.idx and g.old_blob = c.new_blob and g.k = c.k)
select repo_id, idx, old_path, new_path, old_blob, new_blob from x where old_blob is not null and new_blob is not null union all select * from m""")
def tree_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What commits change; some ends and beginnings are left out, so that files come, go and are renamed."""
    trees = _trees(spark, sf_dir)
    # a row of its own for each side: an end without a beginning, or the other way round
    ends = trees.filter("valid_to is not null and valid_to <> 5").select("repo_id", "path", "blob_id", F.lit(-1).alias("valid_from"), "valid_to")
    begins = trees.filter("valid_from <> 3").select("repo_id", "path", "blob_id", "valid_from", F.lit(None).cast("int").alias("valid_to"))
    return changes.tree_changes(ends.unionByName(begins)).filter("idx >= 0")


@query("""with recursive d as (select lang, doc_id % 2 = 0 as goes, 'd' || doc_id || '/f' || doc_id % 5 as path, 'f' || doc_id % 5 as name, sha256(text) as blob, text from documents where text is not null),
l as (select blob, line, sum(strlen(line) + 1) as bytes from (select blob, unnest(string_split(text, chr(10))) as line from (select distinct blob, text from d)) group by all), z as (select blob, sum(bytes) as size from l group by blob),
pairs as (select lang, a.blob as o, b.blob as n, sum(least(x.bytes, y.bytes)) as common from (select distinct lang, blob from d where goes) a join l x on x.blob = a.blob join l y on y.line = x.line join (select distinct lang, blob from d where not goes) b using (lang) where b.blob = y.blob group by all),
scored as (select lang, o, n, common / greatest(v.size, w.size) as score from pairs join z v on v.blob = o join z w on w.blob = n where common >= 0.5 * greatest(v.size, w.size)),
c as (select g.lang, g.path as old_path, h.path as new_path, o, n, row_number() over (partition by g.lang order by o <> n, -score, o, n, g.name <> h.name, g.path, h.path) as rank from scored join d g on g.goes and g.lang = scored.lang and g.blob = o join d h on not h.goes and h.lang = scored.lang and h.blob = n),
walk as (select distinct lang, 0::bigint as rank, ''::varchar as old_path, ''::varchar as new_path, ''::varchar as old_blob, ''::varchar as new_blob, []::varchar[] as used from d union all
 select lang, rank, old_path, new_path, o, n, list_concat(used, [old_path, new_path]) from (select w.lang, c.rank, c.old_path, c.new_path, c.o, c.n, used from walk w join c on c.lang = w.lang and c.rank > w.rank where not list_contains(used, c.old_path) and not list_contains(used, c.new_path) qualify row_number() over (partition by w.lang order by c.rank) = 1))
select lang, old_path, new_path, old_blob, new_blob from walk where rank > 0""")
def renamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even ids go and those of odd ids come in one commit for each language; equal and similar ones are renames."""
    own = table(spark, sf_dir, "documents").filter("text is not null").select("lang", "doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("blob"), "text")
    files = own.select("lang", "doc_id", "blob", F.format_string("d%d/f%d", "doc_id", F.col("doc_id") % 5).alias("path"))
    blobs = own.select(F.col("blob").alias("blob_id"), F.col("text").alias("content")).dropDuplicates(["blob_id"])
    return renames.detect(files.filter("doc_id % 2 = 0").drop("doc_id"), files.filter("doc_id % 2 = 1").drop("doc_id"), ["lang"], renames.weighted_lines(blobs))


# files of six folders: three that hold one application, one of them with files of its own, two that hold another one, and one of other content
_SIX_FOLDERS = ("app", "lib/app", "vendor/app", "web", "old/web", "tools")
_COPIES = f"""t as (select distinct ascii(l_returnflag) as repo_id, l_suppkey % 6 as side, l_partkey % 300 as n from lineitem where l_suppkey % 6 <> 5 or l_partkey % 300 < 200),
f as (select repo_id, {_picked(_SIX_FOLDERS, "side")} || '/m' || n % 12 || '/F' || n || '.java' as path, 12 + n % 7 as lines, n, side from t),
l as (select repo_id, path, lines, 'line ' || k || ' of ' || n || case when side in (0, 2) or side = 1 and n % 10 > 0 then ' a' when side in (3, 4) then ' w' else ' s' || side end as text from f, range(0, 19) g(k) where k < lines),
c as (select a.repo_id, least(left(a.path, length(a.path) - length(a.rel) - 1), left(b.path, length(b.path) - length(b.rel) - 1)) as root_a, greatest(left(a.path, length(a.path) - length(a.rel) - 1), left(b.path, length(b.path) - length(b.rel) - 1)) as root_b, a.rel as suffix
 from (select *, 'm' || n % 12 || '/F' || n || '.java' as rel from f) a join (select *, 'm' || n % 12 || '/F' || n || '.java' as rel from f) b on a.repo_id = b.repo_id and a.rel = b.rel and a.path < b.path),
size as (select repo_id, path[:length(path) - length('/m' || n % 12 || '/F' || n || '.java')] as root, count(*) as files, sum(lines) as lines from f group by all),
big as (select c.repo_id, root_a, root_b, count(*) as shared, any_value(x.files) as fa, any_value(y.files) as fb, any_value(x.lines) as la, any_value(y.lines) as lb from c join size x on x.repo_id = c.repo_id and x.root = root_a join size y on y.repo_id = c.repo_id and y.root = root_b
 group by all having count(*) >= 25 and count(*) >= 0.7 * least(any_value(x.files), any_value(y.files))),
ranked as (select c.*, row_number() over (partition by repo_id, root_a, root_b order by suffix) - 1 as r, greatest(1, shared // 24) as step from c join big using (repo_id, root_a, root_b)),
sample as (select * from ranked where r % step = 0 qualify row_number() over (partition by repo_id, root_a, root_b order by suffix) <= 24),
same as (select s.repo_id, root_a, root_b, suffix, count(*) as common from sample s join l x on x.repo_id = s.repo_id and x.path = root_a || '/' || suffix join l y on y.repo_id = s.repo_id and y.path = root_b || '/' || suffix and y.text = x.text group by all),
share as (select s.repo_id, root_a, root_b, avg(case when coalesce(common, 0) >= 0.9 * lines then 1.0::double else 0.0::double end) as identical from sample s left join same using (repo_id, root_a, root_b, suffix) join f on f.repo_id = s.repo_id and f.path = root_a || '/' || suffix group by all),
ready as (select *, case when la <> lb then lb < la when len(string_split(root_a, '/')) <> len(string_split(root_b, '/')) then len(string_split(root_b, '/')) > len(string_split(root_a, '/')) else root_b > root_a end as drop_b, row_number() over (partition by repo_id order by root_a, root_b) as k from big join share using (repo_id, root_a, root_b) where identical >= 0.75),
walk as (select distinct repo_id, 0::bigint as k, ''::varchar as original, ''::varchar as mirror, 0::bigint as shared, 0::hugeint as lines, 0::double as identical, []::varchar[] as gone from f union all
 select repo_id, k, original, mirror, shared, lines, identical, list_append(gone, mirror) from (select w.repo_id, r.k, case when drop_b then root_a else root_b end as original, case when drop_b then root_b else root_a end as mirror, r.shared, case when drop_b then lb else la end as lines, r.identical, gone from walk w join ready r on r.repo_id = w.repo_id and r.k > w.k
 where len(list_filter(gone, lambda d: d = root_a or d = root_b or starts_with(root_a, d || '/') or starts_with(root_b, d || '/') or starts_with(d, root_a || '/') or starts_with(d, root_b || '/'))) = 0 qualify row_number() over (partition by w.repo_id order by r.k) = 1))"""


def _copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "lineitem").select(F.ascii("l_returnflag").alias("repo_id"), (F.col("l_suppkey") % 6).alias("side"), (F.col("l_partkey") % 300).alias("n")).filter("side <> 5 or n < 200").distinct()
    n, side = F.col("n"), F.col("side")
    files = own.withColumns({"path": F.concat(_pick(_SIX_FOLDERS, side), F.lit("/m"), (n % 12).cast("string"), F.lit("/F"), n.cast("string"), F.lit(".java")), "code_lines": (12 + n % 7).cast("int")})
    mark = F.when(side.isin(0, 2) | ((side == 1) & (n % 10 > 0)), " a").when(side.isin(3, 4), " w").otherwise(F.concat(F.lit(" s"), side.cast("string")))
    text = files.select("repo_id", "path", "n", mark.alias("mark"), F.explode(F.sequence(F.lit(0), F.col("code_lines") - 1)).alias("k")).select("repo_id", "path", F.concat(F.lit("line "), F.col("k").cast("string"), F.lit(" of "), n.cast("string"), "mark").alias("text"))
    return files.select("repo_id", "path", "code_lines", F.col("code_lines").alias("norm_lines")), text


@query(f"with recursive {_COPIES} select repo_id, original, mirror, shared::int as shared_paths, lines::int as dropped_lines, round(identical, 9) as identical_share, (row_number() over (partition by repo_id order by lines desc, original, mirror))::int as rank from walk where k > 0")
def mirrored_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that hold what others hold, where the mirror of one pair is in others too."""
    return mirrors.detect(*_copies(spark, sf_dir)).withColumn("identical_share", F.round("identical_share", 9))


@query(f"with recursive {_COPIES} select f.repo_id, mirror, count(*) as files, sum(f.lines)::bigint as lines from walk join f on f.repo_id = walk.repo_id and starts_with(path, mirror || '/') where k > 0 group by all")
def excluded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mirrors leave out of the measured files."""
    files, text = _copies(spark, sf_dir)
    return mirrors.excluded(files, mirrors.detect(files, text)).join(files, ["repo_id", "path"]).groupBy("repo_id", "mirror").agg(F.count("*").alias("files"), F.sum("code_lines").alias("lines"))


_RUNS = "r as (select o_custkey % 40 as repo_id, o_orderkey as started_at, case o_orderstatus when 'F' then 'OK' when 'O' then 'RUNNING' else 'QUEUED' end as status, o_totalprice as price from orders where o_custkey % 40 < 30 or o_orderstatus <> 'F')"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "OK").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("QUEUED")
    return table(spark, sf_dir, "orders").filter("o_custkey % 40 < 30 or o_orderstatus <> 'F'").select((F.col("o_custkey") % 40).alias("repo_id"), F.col("o_orderkey").alias("started_at"), status.alias("status"), F.col("o_totalprice").alias("price"))


@query(f"with {_RUNS} select repo_id, started_at, status, price from (select *, row_number() over (partition by repo_id order by started_at desc) as k from r where status = 'OK') where k = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.latest_ok(_runs(spark, sf_dir))


@query(f"with {_RUNS}, s as (select s_suppkey as repo_id, s_name as name from supplier where s_suppkey < 60) select repo_id, name, repo_id in (select repo_id from r where status = 'OK') as has_report, (row_number() over (order by lower(name), repo_id))::int as place from s")
def repos_with_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    repos = table(spark, sf_dir, "supplier").filter("s_suppkey < 60").select(F.col("s_suppkey").alias("repo_id"), F.col("s_name").alias("name"))
    out = sinks.with_reports(repos, _runs(spark, sf_dir))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.lower("name"), "repo_id")))  # at most 60 rows


@query(f"with {_RUNS} select started_at, case when status in ('QUEUED', 'RUNNING') and started_at <= 700000 - 600000 then 'FAILED' else status end as status from r")
def released_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).select("started_at", sinks.released(F.col("status"), F.col("started_at"), F.lit(700_000)).alias("status"))


# ---------------------------------------------------------------- code of known pieces

_FIGURES = ("bare", "broad", "swallow", "suppress", "functions", "function_lines", "calls", "decisions", "comment_lines", "total_lines")
#: pieces of code by language, with what each adds to the figures above
_PIECES = {
    "py": (
        ("def f(x):\n    return g(x)\n", (0, 0, 0, 0, 1, 1, 2, 0, 0, 2)),
        ("try:\n    a()\nexcept:\n    pass\n", (0, 0, 1, 0, 0, 0, 1, 1, 0, 4)),
        ("try:\n    a()\nexcept:\n    b()\n", (1, 0, 0, 0, 0, 0, 2, 1, 0, 4)),
        ("try:\n    a()\nexcept Exception as e:  # why\n    raise\n", (0, 1, 0, 0, 0, 0, 1, 1, 0, 4)),
        ("# note\n\nwith suppress(KeyError):\n    b('#')\n", (0, 0, 0, 1, 0, 0, 2, 0, 1, 3)),
        ("async def h():\n    if a and b:\n        c()\n    return 1\n", (0, 0, 0, 0, 1, 3, 2, 2, 0, 4)),
    ),
    "java": (
        ("  int f(int x) {\n    if (x > 0) {\n      return g(x);\n    }\n  }\n", (0, 0, 0, 0, 1, 3, 2, 1, 0, 5)),
        ("try { a(); } catch (Exception e) {\n}\n", (0, 0, 1, 0, 0, 0, 1, 1, 0, 2)),
        ("try { a(); } catch (IOException e) {\n  throw e;\n}\n", (0, 0, 0, 0, 0, 0, 1, 1, 0, 3)),
        ("try { a(); } catch (final Throwable t) {\n  fix(t);\n}\n", (0, 1, 0, 0, 0, 0, 2, 1, 0, 3)),
        ("/* a\n b */\n// c\nint x = y /* d */ ? 1 : 2; // e\n", (0, 0, 0, 0, 0, 0, 0, 1, 3, 4)),
        ("void g() {\n  a(); /* {\n } */ b();\n}\n", (0, 0, 0, 0, 1, 2, 3, 0, 0, 4)),
    ),
    "ts": (
        ("const f = (x) => {\n  return g(x);\n}\n", (0, 0, 0, 0, 1, 1, 1, 0, 0, 3)),
        ("p.catch(() => {})\n", (0, 0, 2, 0, 0, 0, 0, 1, 0, 1)),
        ("try { a(); } catch (e) {\n  console.log(e);\n}\n", (0, 0, 1, 0, 0, 0, 2, 1, 0, 3)),
        ("try { a(); } catch (e) {\n  fix(e);\n}\n", (0, 0, 0, 0, 0, 0, 2, 1, 0, 3)),
        ("const u = `// no`; // yes\nlet v = a && b || c;\n", (0, 0, 0, 0, 0, 0, 0, 2, 0, 2)),
        ("function k(y) {\n  while (y) { y = z(y); }\n}\n", (0, 0, 0, 0, 1, 1, 2, 1, 0, 3)),
    ),
}


def _times(k: str, i: int) -> str:
    """How often piece i is in file k."""
    return f"(({k} // {4**i}) % 4)"


@query(
    "with p as (select p_partkey as k from part) select k, case k % 3 when 0 then 'PYTHON' when 1 then 'JAVA' else 'JAVASCRIPT' end as lang, "
    + ", ".join("(case k % 3 " + " ".join(f"when {n} then " + " + ".join(f"{_times('k', i)} * {add[f]}" for i, (_, add) in enumerate(_PIECES[ext])) for n, ext in enumerate(_PIECES)) + f" end)::int as {name}" for f, name in enumerate(_FIGURES))
    + " from p"
)
def code_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files put together from pieces: handlers, functions, calls, decisions and comments are the sums of the pieces'."""
    k = F.col("p_partkey")

    def content(ext: str) -> Column:
        return F.concat(*[F.repeat(F.lit(piece), F.expr(f"cast(floor(p_partkey / {4**i}) % 4 as int)")) for i, (piece, _) in enumerate(_PIECES[ext])])

    exts = tuple(_PIECES)
    own = table(spark, sf_dir, "part").select(k.cast("string").alias("blob_id"), F.concat(F.lit("src/f."), _pick(exts, k)).alias("path"), F.when(k % 3 == 0, content("py")).when(k % 3 == 1, content("java")).otherwise(content("ts")).alias("content"))
    return lines.file_views(own).select(F.col("blob_id").cast("long").alias("k"), "lang", *_FIGURES)


_ERRORS = ("Could not resolve host: ", "repository not found: ", "Authentication failed for ", "The requested URL returned error: 403 from ", "does not appear to be a git repository: ", "operation timed out after 15 s: ", "Connection refused by author.", "git-upload-pack not permitted on ", "error: 404 ", "port 14031 refused by ")


@query(f"""with e as (select page_id, lower({_picked(_ERRORS, "page_id")} || coalesce(url, '')) as m from pages)
select page_id, case when regexp_matches(m, 'not authori[sz]ed|authentication (is required|failed)|(^|[^0-9])40[13]([^0-9]|$)|not (permitted|granted)|could not read username') then 'notAuthorized' when contains(m, 'not a git repository') or contains(m, 'does not appear to be a git repository') then 'notGitRepository'
 when regexp_matches(m, 'not found|(^|[^0-9])404([^0-9]|$)|does not exist') then 'notFound' when contains(m, 'timed out') or contains(m, 'timeout') then 'timeout' else 'unreachable' end as category from e""")
def probe_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each page's host couldn't be read, by what a probe would have said."""
    message = F.concat(_pick(_ERRORS, F.col("page_id")), F.coalesce("url", F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", X.probe_error(message).alias("category"))
