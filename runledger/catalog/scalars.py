"""Scalar functions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from runledger.catalog.base import query
from runledger.functions import codes, names, paths, sizes


@query(
    "parse_size",
    "FN1",
    r"""
    with cut as (
      select p_partkey, text, regexp_extract(text, '^\s*([0-9]*\.?[0-9]+)\s*([a-zA-Z]*)\s*$', 1) as num,
             lower(regexp_extract(text, '^\s*([0-9]*\.?[0-9]+)\s*([a-zA-Z]*)\s*$', 2)) as unit from sizes),
    scaled as (
      select p_partkey, text, num, unit,
             case unit when '' then 1 when 'gb' then 1000000000 when 'gib' then 1073741824 when 'k' then 1000
                       when 'mib' then 1048576 when 't' then 1000000000000 end as mult from cut)
    select p_partkey, text, cast(floor(try_cast(num as double) * mult) as bigint) as bytes,
           case when num = '' then 'not a size' when mult is null then 'unknown unit' end as error
    from scaled""",
)
def _(t):
    text = F.col("text")
    return t.sizes.select("p_partkey", "text", sizes.parse_size(text).alias("bytes"), sizes.size_error(text).alias("error"))


FOOTPRINT = """
    select o_orderkey, case when o_orderkey % 5 = 0 then null else (o_orderkey % 64) / 4.0 end as cpus, o_orderkey % 7 = 0 as cpus_all,
           case when o_orderkey % 3 = 0 then null else cast(round(o_totalprice * 100) as bigint) * (o_orderkey % 1000 + 1) end as memory from orders"""


@query(
    "format_size",
    "FN2",
    """
    with b as (select l_orderkey, l_linenumber, l_partkey, cast(l_partkey * l_suppkey * (l_linenumber * l_linenumber + 60) as bigint) as n from lineitem)
    select l_orderkey, l_linenumber, l_partkey, n,
           case when n >= 1125899906842624 then printf('%.1fPiB', n / 1125899906842624.0::double)
                when n >= 1099511627776 then printf('%.1fTiB', n / 1099511627776.0::double)
                when n >= 1073741824 then printf('%.1fGiB', n / 1073741824.0::double)
                when n >= 1048576 then printf('%.1fMiB', n / 1048576.0::double)
                when n >= 1024 then printf('%.1fKiB', n / 1024.0::double) else concat(n, 'B') end as label
    from b""",
)
def _(t):
    n = (F.col("l_partkey") * F.col("l_suppkey") * (F.col("l_linenumber") * F.col("l_linenumber") + 60)).cast("bigint")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", n.alias("n")).withColumn("label", sizes.format_size(F.col("n")))


@query(
    "explain_returncode",
    "FN3",
    """
    with r as (select o_orderkey, cast(o_orderkey % 90 as integer) - 80 as code from orders)
    select o_orderkey, code, case
      when code = -9 then '-9 (SIGKILL -- killed by the OS, most often an out-of-memory kill; check the step''s declared resources against what it actually used)'
      when code between -31 and -1 and code <> -16 then concat(code, ' (', list_extract(['SIGHUP','SIGINT','SIGQUIT','SIGILL','SIGTRAP','SIGABRT','SIGBUS','SIGFPE','SIGKILL',
        'SIGUSR1','SIGSEGV','SIGUSR2','SIGPIPE','SIGALRM','SIGTERM','SIGSTKFLT','SIGCHLD','SIGCONT','SIGSTOP','SIGTSTP','SIGTTIN','SIGTTOU','SIGURG','SIGXCPU',
        'SIGXFSZ','SIGVTALRM','SIGPROF','SIGWINCH','SIGIO','SIGPWR','SIGSYS'], -code), ')')
      when code = -16 then '-16 (SIGSTKFLT)'
      when code = -34 then '-34 (SIGRTMIN)' when code = -64 then '-64 (SIGRTMAX)' else cast(code as varchar) end as text
    from r""",
)
def _(t):
    coded = t.orders.select("o_orderkey", (F.col("o_orderkey") % 90 - 80).cast("int").alias("code"))
    return coded.withColumn("text", codes.explain_returncode(F.col("code")))


@query(
    "split_ref",
    "FN4",
    """
    with a as (select p_partkey, ref, strpos(ref, '://') as cut from refs),
    b as (select p_partkey, ref, case when cut > 0 then substr(ref, cut + 3) else ref end as rest,
                 cut = 0 or substr(ref, 1, cut - 1) = 'docker' as usable from a),
    c as (select p_partkey, ref, usable,
                 case when strpos(rest, '@') > 0 then split_part(rest, '@', 1)
                      when strpos(split_part(rest, '/', -1), ':') > 0 then substr(rest, 1, length(rest) - 1 - length(split_part(rest, ':', -1)))
                      else rest end as name,
                 case when strpos(rest, '@') > 0 then substr(rest, strpos(rest, '@') + 1)
                      when strpos(split_part(rest, '/', -1), ':') > 0 then split_part(rest, ':', -1) else 'latest' end as reference from b),
    d as (select *, strpos(name, '/') > 0 and (strpos(split_part(name, '/', 1), '.') > 0 or strpos(split_part(name, '/', 1), ':') > 0
                 or split_part(name, '/', 1) = 'localhost') as hosted from c)
    select p_partkey, ref, case when usable then case when hosted then split_part(name, '/', 1) else 'registry-1.docker.io' end end as registry,
           case when usable then case when hosted then substr(name, strpos(name, '/') + 1) when strpos(name, '/') > 0 then name else 'library/' || name end end as repository,
           case when usable then reference end as reference
    from d""",
)
def _(t):
    return t.refs.withColumn("s", names.split_ref(F.col("ref"))).select("p_partkey", "ref", "s.registry", "s.repository", "s.reference")


@query(
    "pin_ref",
    "FN5",
    """
    select p_partkey, ref, concat(regexp_replace(regexp_replace(ref, '@.*$', ''), ':[^/:]*$', ''), '@', digest) as pinned from refs""",
)
def _(t):
    return t.refs.select("p_partkey", "ref", names.pin_ref(F.col("ref"), F.col("digest")).alias("pinned"))


WORK_PATHS = """
    select page_id, case when page_id % 3 = 0 then concat('/', path) when page_id % 3 = 1 then concat('/ws/', path) else path end as path,
           path as bare from files"""


@query(
    "anchor_paths",
    "FN6",
    f"""
    with p as ({WORK_PATHS})
    select page_id, path, case when path[1] = '/' then path else '/ws/' || path end as absolute,
           case when path[1:4] = '/ws/' then path[5:] else path end as relative,
           case when path[1] = '/' then path else '/ws/' || path end || ',' || '/ws/' || bare as absolute_list
    from p""",
)
def _(t):
    p, base = F.col("path"), F.lit("/ws")
    return t.sql(WORK_PATHS).select(
        "page_id",
        "path",
        paths.absolutize(p, base).alias("absolute"),
        paths.relativize(p, base).alias("relative"),
        F.array_join(paths.absolutize_all(F.array("path", "bare"), base), ",").alias("absolute_list"),
    )


GLOBS = """
    select page_id, concat(case page_id % 5 when 0 then '' when 1 then './' when 2 then '/' when 3 then '../' else 'a//b/./' end, path,
           case page_id % 4 when 0 then '/x-*.fits' when 1 then '*/y' when 2 then '' else '/[ab]/c' end) as pattern from files"""


@query(
    "literal_prefix",
    "FN7",
    rf"""
    with g as ({GLOBS}),
    parts as (select page_id, pattern, starts_with(pattern, '/') as rooted,
                     list_filter(string_split(pattern, '/'), lambda x: x <> '' and x <> '.') as s from g),
    dirs as (select page_id, pattern, rooted, s[1:len(s) - 1] as d from parts),
    kept as (select page_id, pattern, rooted, d[1:coalesce(list_position(list_transform(d, lambda x: regexp_matches(x, '[*?\[]')), true) - 1, len(d))] as k from dirs)
    select page_id, pattern, case when list_contains(k, '..') then null when rooted then '/' || array_to_string(k, '/')
           when len(k) = 0 then null else array_to_string(k, '/') end as prefix
    from kept""",
)
def _(t):
    return t.sql(GLOBS).select("page_id", "pattern", paths.literal_prefix(F.col("pattern")).alias("prefix"))


@query(
    "paths_overlap",
    "FN8",
    """
    with p as (select page_id, path as a, case page_id % 4 when 0 then path || '/part' when 1 then split_part(path, '/', 1)
                      when 2 then path || 'x' else './' || path end as b from files)
    select page_id, a, b, page_id % 4 <> 2 as overlaps from p""",
)
def _(t):
    b = (
        F.when(F.col("page_id") % 4 == 0, F.concat("path", F.lit("/part")))
        .when(F.col("page_id") % 4 == 1, F.substring_index("path", "/", 1))
        .when(F.col("page_id") % 4 == 2, F.concat("path", F.lit("x")))
        .otherwise(F.concat(F.lit("./"), "path"))
    )
    pairs = t.files.select("page_id", F.col("path").alias("a"), b.alias("b"))
    return pairs.withColumn("overlaps", paths.paths_overlap(F.col("a"), F.col("b")))


@query(
    "display_label",
    "FN9",
    """select page_id, path as dotted, case when strpos(path, '.') > 0 then substr(path, strpos(path, '.') + 1) else path end as label from files""",
)
def _(t):
    return t.files.select("page_id", F.col("path").alias("dotted"), names.display_label(F.col("path")).alias("label"))


@query(
    "shorten",
    "FN10",
    r"""
    with l as (select doc_id, trim(regexp_replace(text, '[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) as line from documents)
    select doc_id, case when length(line) <= 60 then line else rtrim(substring(line, 1, 57)) || '...' end as short from l""",
)
def _(t):
    return t.documents.select("doc_id", names.shorten(F.col("text"), 60).alias("short"))


@query(
    "state_names",
    "FN11",
    """
    select page_id, concat('k', page_id, '__', regexp_replace(path, '[^\\p{L}\\p{N}_-]', '_', 'g')) as state,
           concat('gen0__', substr(sha256(concat(length(path), ':', path, chr(31), length(cast(size as varchar)), ':', size)), 1, 32)) as gen0
    from files""".replace("\\\\", "\\"),
)
def _(t):
    return t.files.select(
        "page_id",
        names.state_name(F.concat(F.lit("k"), F.col("page_id").cast("string")), F.col("path")).alias("state"),
        names.gen0_name(F.col("path"), F.col("size")).alias("gen0"),
    )


SPECS = """
    select p_partkey, concat(replace(p_name, ' ', '-'), case p_partkey % 6 when 0 then '==1.2' when 1 then '>=1' when 2 then '=== 2.0 '
           when 3 then '' when 4 then '==1.*,<2' else '~=3.1' end) as spec from part"""


@query(
    "unpinned_specs",
    "FN12",
    f"""select p_partkey, spec, p_partkey % 6 not in (0, 2) as unpinned from ({SPECS}) s""",
)
def _(t):
    return t.sql(SPECS).select("p_partkey", "spec", names.is_unpinned(F.col("spec")).alias("unpinned"))


@query(
    "env_id",
    "FN13",
    """
    select p_partkey, substr(sha256(concat(p_name, chr(0), p_brand, chr(0),
             case when p_partkey % 2 = 0 then concat('extra=a', chr(0), 'extra=b', chr(0), 'group=dev') else 'group=dev' end, chr(0),
             '3.', p_size, chr(0), 'sync', chr(0), 'x86_64/glibc-2.39/3.12', chr(0))), 1, 16) as env
    from part""",
)
def _(t):
    extras = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array().cast("array<string>"))
    return t.part.select(
        "p_partkey",
        names.env_id(
            F.col("p_name"),
            F.col("p_brand"),
            extras,
            F.array(F.lit("dev")),
            F.concat(F.lit("3."), F.col("p_size").cast("string")),
            F.lit("sync"),
            F.lit("x86_64/glibc-2.39/3.12"),
        ).alias("env"),
    )


@query(
    "json_dump",
    "FN14",
    """select o_orderkey, cast(json_object('o_orderkey', o_orderkey, 'o_orderstatus', o_orderstatus, 'note', case when o_orderkey % 2 = 0 then o_orderpriority end) as varchar) as doc from orders""",
)
def _(t):
    noted = t.orders.withColumn("note", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")))
    return noted.select("o_orderkey", names.to_json_safe("o_orderkey", "o_orderstatus", "note").alias("doc"))


@query(
    "request_units",
    "FN15",
    f"""
    select o_orderkey, case when cpus is not null and not cpus_all then greatest(1, cast(ceil(cpus) as bigint)) end as cpus,
           case when memory is not null then greatest(1, (memory + 1048575) // 1048576) end as mem_mib
    from ({FOOTPRINT}) f""",
)
def _(t):
    f = t.sql(FOOTPRINT)
    return f.select(
        "o_orderkey",
        sizes.request_cpus(F.col("cpus").cast("double"), F.col("cpus_all")).alias("cpus"),
        sizes.request_mib(F.col("memory")).alias("mem_mib"),
    )


@query(
    "describe_resources",
    "FN16",
    f"""
    with p as (
      select o_orderkey, case when cpus_all then 'cpus=all' when cpus is not null then printf('cpus=%g', cpus::double) end as c,
             case when memory >= 1099511627776 then printf('memory=%.1fTiB', memory / 1099511627776.0::double)
                  when memory >= 1073741824 then printf('memory=%.1fGiB', memory / 1073741824.0::double)
                  when memory >= 1048576 then printf('memory=%.1fMiB', memory / 1048576.0::double)
                  when memory >= 1024 then printf('memory=%.1fKiB', memory / 1024.0::double)
                  when memory is not null then printf('memory=%dB', memory) end as m from ({FOOTPRINT}) f)
    select o_orderkey, case when c is null and m is null then 'unbounded' else concat_ws(', ', c, m) end as footprint from p""",
)
def _(t):
    f = t.sql(FOOTPRINT)
    return f.select(
        "o_orderkey", sizes.describe_resources(F.col("cpus").cast("double"), F.col("cpus_all"), F.col("memory")).alias("footprint")
    )


@query(
    "safe_names",
    "FN17",
    """select page_id, path, not regexp_matches(path, '[^A-Za-z0-9._-]') and path <> '' as safe from files""",
)
def _(t):
    return t.files.select("page_id", "path", names.is_safe_name(F.col("path")).alias("safe"))


@query(
    "run_status",
    "FN18",
    """
    select o_orderkey, case o_orderkey % 4 when 0 then case when o_orderkey % 128 = 0 then 'FINISHED (success)' else concat('FINISHED (exit ', o_orderkey % 128, ')') end
           when 1 then 'RUNNING' when 2 then 'UNKNOWN' else 'UNKNOWN' end as status from orders""",
)
def _(t):
    k = F.col("o_orderkey")
    reply = (
        F.when(k % 4 == 0, F.concat((k % 128).cast("string"), F.lit(" ")))
        .when(k % 4 == 1, F.lit("RUNNING"))
        .when(k % 4 == 2, F.lit("UNKNOWN"))
        .otherwise(F.concat(F.lit("-"), k.cast("string")))
    )
    return t.orders.select("o_orderkey", codes.run_status(reply).alias("status"))


REMOTES = """
    select page_id, concat(case page_id % 5 when 0 then 'me@' when 1 then '-oProxy' when 2 then '' when 3 then 'a b@' else 'x@y@' end,
           split_part(path, '/', 1), case when page_id % 7 = 0 then '' else ':' end, case when page_id % 11 = 0 then '' else '/data' end) as spec from files"""


@query(
    "parse_remote",
    "FN19",
    f"""
    with s as (select page_id, spec, split_part(spec, ':', 1) as host, substr(spec, strpos(spec, ':') + 1) as path from ({REMOTES}) r),
    u as (select *, strpos(spec, ':') > 0 and host <> '' and path <> ''
                 and regexp_full_match(host, '[A-Za-z0-9_][A-Za-z0-9._-]*(@[A-Za-z0-9_][A-Za-z0-9._:-]*)?') as ok from s)
    select page_id, spec, case when ok then host end as host, case when ok then path end as path from u""",
)
def _(t):
    return t.sql(REMOTES).withColumn("r", names.parse_remote(F.col("spec"))).select("page_id", "spec", "r.host", "r.path")


@query(
    "submit_reply_id",
    "FN20",
    "select o_orderkey, cast(o_orderkey as varchar) as job_id from orders",
)
def _(t):
    reply = F.concat(F.lit(" "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(";main\n")).otherwise(F.lit(" ")))
    return t.orders.select("o_orderkey", codes.job_id(F.regexp_replace(reply, r"\n", "")).alias("job_id"))


@query(
    "parse_platform",
    "FN21",
    """
    select p_partkey, case when p_partkey % 4 in (0, 1) then 'x86_64' end as machine,
           case when p_partkey % 4 in (0, 1) then concat('glibc-2.', p_size) end as libc, case when p_partkey % 4 in (0, 1) then '3.12' end as python
    from part""",
)
def _(t):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("x86_64/glibc-2."), size, F.lit("/3.12")))
        .when(k == 1, F.concat(F.lit("  x86_64/glibc-2."), size, F.lit("/3.12 ")))
        .when(k == 2, F.concat(F.lit("x86_64/glibc "), size, F.lit("/3.12")))
        .otherwise(F.concat(F.lit("x86_64/"), size))
    )
    return t.part.select("p_partkey", names.parse_platform(text).alias("p")).select("p_partkey", "p.machine", "p.libc", "p.python")
