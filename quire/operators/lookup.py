"""File indexes, the catalogue of manuals, and the resolution of requests and references by joins."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import basename, extension, or_default, query_value, server_path, stem, strip, url_parts, zero_pad
from quire.operators.ordered import last_wins

# Extensions of assets.
ASSET_EXTENSIONS = [".jpg", ".jpeg", ".gif", ".png", ".svg", ".pdf"]

# Manual archive and the wiring archive that exports pair with it.
WIRING_OF_MANUAL = {
    "SE2": "EE2", "SCA": "EEA", "SEB": "EEB", "SED": "EED", "SEF": "EEF", "SDG": "EEG", "SEH": "EEH",
    "SEI": "EEI", "SEJ": "EEJ", "SEK": "EEK", "SEM": "EEM", "SEN": "EEN", "SEO": "EEO", "SEP": "EEP",
    "SER": "EER", "SDS": "EES", "SDZ": "EET", "SEV": "EEV", "SCY": "EEY",
}
# The manuals that the catalogue lists, their labels and index pages.
CATALOGUE = [
    ("SE2", "2014 F-150", "SE2ALPHAINDEX.HTM"),
    ("SEB", "2014 Mustang", "SEBALPHAINDEX.HTM"),
    ("SCA", "2012–2014 Focus Electric", None),
    ("SCY", "2012–2014 Focus", None),
    ("SDS", "2013–2014 Fusion", "SDSALPHAINDEX.HTM"),
    ("SDE", "2013–2014 Fusion Hybrid/Energi", "SDEALPHAINDEX.HTM"),
    ("SDG", "2013–2014 C-MAX Hybrid/Energi", "SDGALPHAINDEX.HTM"),
    ("SDL", "2013–2014 MKZ", "SDLALPHAINDEX.HTM"),
    ("SDW", "2013–2014 MKZ Hybrid", "SDWALPHAINDEX.HTM"),
    ("SDZ", "2013–2014 Escape", "SDZALPHAINDEX.HTM"),
    ("SED", "2014 Flex", "SEDALPHAINDEX.HTM"),
    ("SEF", "2014 Taurus / Police Interceptor Sedan", "SEFALPHAINDEX.HTM"),
    ("SEH", "2014 MKS", "SEHALPHAINDEX.HTM"),
    ("SEI", "2014 F-53 Motorhome / F-59 Stripped Chassis", "SEIALPHAINDEX.HTM"),
    ("SEJ", "2014 Expedition / Navigator", "SEJALPHAINDEX.HTM"),
    ("SEM", "2014 E-Series", "SEMALPHAINDEX.HTM"),
    ("SEN", "2014 Explorer / Police Interceptor Utility", "SENALPHAINDEX.HTM"),
    ("SEO", "2014 F-250/350/450/550 Super Duty", "SEOALPHAINDEX.HTM"),
    ("SEP", "2014 MKT", "SEPALPHAINDEX.HTM"),
    ("SER", "2014 Fiesta", "SERALPHAINDEX.HTM"),
    ("SEV", "2014 Edge / MKX", "SEVALPHAINDEX.HTM"),
    ("SIB", "Noise, Vibration & Harshness", "SIBALPHAINDEX.HTM"),
    ("SIA", "7.3L DI Turbo Diesel (1997–2015)", None),
    ("VE2", "Gasoline Engines Reference", None),
    ("VEF", "6.7L Diesel Reference", None),
    ("VEM", "Hybrid Reference", None),
]
#: The server's pairs lack one that exports have.
SERVER_WIRING = {m: w for m, w in WIRING_OF_MANUAL.items() if m != "SEI"}


def wiring_map(spark: SparkSession, pairs: dict[str, str] = WIRING_OF_MANUAL) -> DataFrame:
    return spark.createDataFrame(list(pairs.items()), "manual_arc string, wiring_arc string")


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(CATALOGUE)], "place int, arc string, label string, index_file string")


def with_wiring(rows: DataFrame, pairs: DataFrame, arc: str = "arc", override: Column | None = None) -> DataFrame:
    """``wiring_arc``: the override, else the paired archive, else null."""
    paired = rows.join(pairs.select(F.col("manual_arc").alias("_m"), F.col("wiring_arc").alias("_w")), F.col(arc) == F.col("_m"), "left")
    found = F.coalesce(override, F.col("_w")) if override is not None else F.col("_w")
    return paired.withColumn("wiring_arc", found).drop("_m", "_w")


def file_index(files: DataFrame) -> DataFrame:
    """(arc, basename_lc, path) of files (arc, path); of equal names in an archive the last path."""
    rows = files.select(F.upper("arc").alias("arc"), F.lower(basename(F.col("path"))).alias("basename_lc"), "path")
    return last_wins(rows, ["arc", "basename_lc"], ["path"])


def global_index(index: DataFrame) -> DataFrame:
    """(basename_lc, path): one path per name, the last by archive and path."""
    return last_wins(index, ["basename_lc"], ["arc", "path"]).select("basename_lc", "path")


def index_sizes(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("arc").alias("n_arcs"))


def find_files(names: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """``path`` of each bare name, null where there is none."""
    found = global_index(index).withColumnRenamed("basename_lc", "_key")
    return names.join(found, F.lower(name) == F.col("_key"), "left").drop("_key")


def find_arc_files(names: DataFrame, index: DataFrame, arc: str = "arc", name: str = "name") -> DataFrame:
    """``path`` of each name in its archive, whatever the case."""
    found = index.select(F.col("arc").alias("_arc"), F.col("basename_lc").alias("_key"), "path")
    return names.join(found, (F.upper(arc) == F.col("_arc")) & (F.lower(name) == F.col("_key")), "left").drop("_arc", "_key")


def resolved_sides(names: DataFrame, index: DataFrame, name: str = "name") -> DataFrame:
    """``url`` of each side of a frameset: empty gives the root, a miss the name under the root."""
    found = find_files(names, index, name)
    url = F.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit("/")).otherwise(F.concat(F.lit("/"), F.coalesce("path", F.col(name))))
    return found.withColumn("url", url).drop("path")


def resolved_requests(requests: DataFrame, index: DataFrame, path: str = "request") -> DataFrame:
    """``rule`` and ``target`` of each request path: home, file (exact or in another case), redirect
    within and across archives, folder, or missing. Paths of the index are ``ARC/name``."""
    decoded = server_path(url_parts(F.col(path))["path"])
    rel = F.regexp_replace(decoded, "^/+", "")
    rows = requests.withColumn("_rel", rel).withColumn("_arc", F.upper(F.regexp_extract("_rel", "^([^/]*)", 1))).withColumn("_rest", F.regexp_extract("_rel", "^[^/]*/(.*)$", 1))
    rows = rows.withColumn("_deep", F.instr("_rel", "/") > 0).withColumn("_base", F.lower(basename(F.col("_rel")))).withColumn("_rest_lc", F.lower("_rest"))
    exact = index.select(F.col("path").alias("_exact")).distinct()
    local = index.select(F.col("arc").alias("_l_arc"), F.col("basename_lc").alias("_l_name"), F.col("path").alias("_local"))
    arcs = index.select(F.col("arc").alias("_there")).distinct()
    anywhere = global_index(index)
    by_rest = anywhere.select(F.col("basename_lc").alias("_g_rest"), F.col("path").alias("_by_rest"))
    by_base = anywhere.select(F.col("basename_lc").alias("_g_base"), F.col("path").alias("_by_base"))
    joined = (
        rows.join(exact, F.col("_deep") & (F.concat("_arc", F.lit("/"), "_rest") == F.col("_exact")), "left")
        .join(local, F.col("_deep") & (F.col("_arc") == F.col("_l_arc")) & (F.col("_rest_lc") == F.col("_l_name")), "left")
        .join(arcs, F.col("_arc") == F.col("_there"), "left")
        .join(by_rest, F.col("_deep") & (F.col("_rest") != "") & (F.col("_rest_lc") == F.col("_g_rest")), "left")
        .join(by_base, (F.col("_base") != "") & (F.col("_base") == F.col("_g_base")), "left")
    )
    known = F.col("_there").isNotNull()
    steps = [
        (F.col("_rel") == "", "home", F.lit("/")),
        (F.col("_exact").isNotNull(), "file", F.concat(F.lit("/"), "_exact")),
        (F.col("_local").isNotNull(), "file_other_case", F.concat(F.lit("/"), "_local")),
        (known & F.col("_by_rest").isNotNull(), "redirect", F.concat(F.lit("/"), "_by_rest")),
        (~F.col("_deep") & known, "folder", F.concat(F.lit("/"), "_arc", F.lit("/"))),
        (F.col("_by_base").isNotNull(), "redirect_anywhere", F.concat(F.lit("/"), "_by_base")),
    ]
    pick = lambda i: reduce(lambda chain, s: chain.when(s[0], s[i] if i > 1 else F.lit(s[i])), steps[1:], F.when(steps[0][0], steps[0][i] if i > 1 else F.lit(steps[0][i])))
    return joined.select(*requests.columns, pick(1).otherwise("missing").alias("rule"), pick(2).alias("target"))


def visible(names: DataFrame, name: str = "name") -> DataFrame:
    """Names that a folder listing shows."""
    return names.where(~F.col(name).startswith("."))


def catalogue_rows(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The manuals that are present: label, link target and wiring archive if present."""
    arcs = index.select("arc").distinct()
    pages = index.select(F.col("arc").alias("_arc"), F.col("path").alias("_path"))
    wiring = wiring_map(spark, SERVER_WIRING).join(arcs.withColumnRenamed("arc", "wiring_arc"), "wiring_arc", "left_semi")
    listed = catalogue(spark).join(arcs, "arc", "left_semi")
    page = (F.col("_arc") == F.col("arc")) & (F.col("_path") == F.concat("arc", F.lit("/"), "index_file"))
    target = F.concat(F.lit("/"), "arc", F.lit("/"), F.when(F.col("_path").isNotNull(), F.col("index_file")).otherwise(""))
    return with_wiring(listed.join(pages, page, "left"), wiring).select("place", "arc", "label", target.alias("target"), "wiring_arc")


def recall_arcs(index: DataFrame) -> DataFrame:
    return index.select("arc").distinct().where(F.col("arc").startswith("R"))


def unmatched_wiring(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Wiring archives that no listed manual shows: matched against what is displayed."""
    present = index.select("arc").distinct().where(F.col("arc").startswith("EE"))
    shown = catalogue_rows(spark, index).where("wiring_arc IS NOT NULL").select(F.col("wiring_arc").alias("arc"))
    return present.join(shown, "arc", "left_anti")


def home_page(spark: SparkSession, index: DataFrame) -> DataFrame:
    """One row: the three parts of the catalogue page as ordered text."""
    rows = catalogue_rows(spark, index)
    line = F.concat("arc", F.lit(" "), "label", F.lit(" "), "target", F.coalesce(F.concat(F.lit(" + Wiring ("), "wiring_arc", F.lit(")")), F.lit("")))
    joined = lambda df, c: F.coalesce(F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["t"]), "\n"), F.lit(""))
    manuals = rows.agg(joined(rows, F.struct("place", line.alias("t"))).alias("manuals"))
    wiring = unmatched_wiring(spark, index).agg(joined(None, F.struct(F.col("arc").alias("t"))).alias("unmatched_wiring"))
    recalls = recall_arcs(index).agg(joined(None, F.struct(F.col("arc").alias("t"))).alias("recalls"))
    # Three one-row tables side by side.
    return manuals.join(wiring, F.lit(True)).join(recalls, F.lit(True))


def wiring_sheets(requests: DataFrame, index: DataFrame, width: int = 3) -> DataFrame:
    """First and further sheets of requests (book, cell): names that begin with the book and the
    padded cell and end in ``.svg``.

    A sheet is listed under each of its prefixes of at least ``width`` characters, as many as its name is
    long, so a prefix lookup is a hash join and the plan needs no look at the requests."""
    sheets = global_index(index).where(F.col("basename_lc").endswith(".svg"))
    asked = requests.withColumn("prefix", F.lower(F.concat(F.upper("book"), zero_pad(F.coalesce("cell", F.lit("")), width))))
    lengths = F.sequence(F.lit(width), F.greatest(F.length("basename_lc"), F.lit(width)))
    cut = sheets.select("path", F.explode(F.transform(lengths, lambda n: F.substring("basename_lc", F.lit(1), n))).alias("prefix"))
    found = cut.join(asked.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix").agg(F.sort_array(F.collect_list("path")).alias("_all"))
    out = asked.join(found, "prefix", "left")
    return out.withColumn("first_sheet", F.get("_all", F.lit(0))).withColumn("more_sheets", F.coalesce(F.slice("_all", 2, F.greatest(F.size("_all"), F.lit(1))), F.array().cast("array<string>"))).drop("_all")


def rewritten_links(links: DataFrame, index: DataFrame, arc: str = "arc", href: str = "href", wiring_arc: str = "wiring_arc") -> DataFrame:
    """``target`` and ``kind`` of each reference of a page, by the first rule that fits.

    absolute: has a scheme or host. wiring_sheet: a wiring page whose sheet is in the paired archive.
    frameset: a two-column page, to the page on its right, else left. page and asset: a file of the
    archive. wiring: a file of the paired archive. other: unchanged. ``asset`` names the file that an
    export has to copy."""
    raw = strip(F.col(href))
    parts = url_parts(raw)
    rows = links.withColumn("_href", raw)
    for name in ("scheme", "netloc", "path", "query", "fragment"):
        rows = rows.withColumn(f"_{name}", parts[name])
    wiring_page = F.lower("_path").endswith("ep_main.asp") & F.col(wiring_arc).isNotNull()
    cell = F.when(wiring_page, strip(query_value(F.col("_query"), "cell", "CELL")))
    side = F.when(F.lower("_path").endswith("2colframeset.asp"), query_value(F.col("_query"), "rightside", "leftside"))
    rows = rows.withColumn("_sheet", F.when(cell != "", F.concat(wiring_arc, cell, F.lit(".svg")))).withColumn("_side", side)
    # References without a sheet, which are most, look for a name that no file has: nulls would meet in one task.
    rows = rows.withColumn("_name", basename(F.col("_path"))).withColumn("_key", F.lower("_name")).withColumn("_sheet_key", F.coalesce(F.lower("_sheet"), F.concat(F.lit("/"), "_key")))
    own = index.select(F.col("arc").alias("_o_arc"), F.col("basename_lc").alias("_o_key")).withColumn("_own", F.lit(True))
    paired = index.select(F.col("arc").alias("_p_arc"), F.col("basename_lc").alias("_p_key")).withColumn("_paired", F.lit(True))
    sheet = index.select(F.col("arc").alias("_s_arc"), F.col("basename_lc").alias("_s_key")).withColumn("_has_sheet", F.lit(True))
    joined = (
        rows.join(own, (F.upper(arc) == F.col("_o_arc")) & (F.col("_key") == F.col("_o_key")), "left")
        .join(paired, (F.upper(wiring_arc) == F.col("_p_arc")) & (F.col("_key") == F.col("_p_key")), "left")
        .join(sheet, (F.upper(wiring_arc) == F.col("_s_arc")) & (F.col("_sheet_key") == F.col("_s_key")), "left")
    )
    tail = F.when(F.col("_fragment") != "", F.concat(F.lit("#"), "_fragment")).otherwise("")
    under = lambda folder, name: F.concat(F.lit(f"../{folder}/"), name)
    ext = extension(F.col("_name"))
    steps = [
        (F.col("_href") == "", "empty", F.lit(""), None),
        ((F.col("_scheme") != "") | (F.col("_netloc") != ""), "absolute", F.col("_href"), None),
        (F.col("_has_sheet"), "wiring_sheet", under("wiring_assets", F.col("_sheet")), F.col("_sheet")),
        (F.col("_side") != "", "frameset", F.concat(stem(F.col("_side")), F.lit(".md"), tail), None),
        (F.col("_side") == "", "other", F.col("_href"), None),
        (F.col("_name") == "", "other", F.col("_href"), None),
        (F.col("_own").isNull() & F.col("_paired"), "wiring", under("wiring_assets", F.col("_name")), F.col("_name")),
        (F.col("_own").isNull(), "other", F.col("_href"), None),
        (ext.isin(".htm", ".html"), "page", F.concat(stem(F.col("_name")), F.lit(".md"), tail), None),
        (ext.isin(ASSET_EXTENSIONS), "asset", F.concat(under("assets", F.col("_name")), tail), F.col("_name")),
    ]

    def pick(i: int, rest: Column) -> Column:
        value = lambda s: F.lit(s[i]) if s[i] is None or isinstance(s[i], str) else s[i]
        return reduce(lambda chain, s: chain.when(s[0], value(s)), steps[1:], F.when(steps[0][0], value(steps[0]))).otherwise(rest)

    return joined.select(*links.columns, pick(1, F.lit("other")).alias("kind"), pick(2, F.col("_href")).alias("target"), pick(3, F.lit(None)).cast("string").alias("asset"))


def image_source(src: Column) -> Column:
    """Images move to the asset folder without a test whether they exist."""
    name = basename(url_parts(src)["path"])
    return F.when(name != "", F.concat(F.lit("../assets/"), name)).otherwise(src)


# The patterns of ``url_parts`` and ``basename`` with Java's end of input, before a last line end too, and its dot.
_END = r"(?:\Z|(?=\r\n\Z)|(?<!\r)(?=\n\Z)|(?=[\r\x85\u2028\u2029]\Z))"
_URL_PATH = re.compile(rf"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)(?:\?[^#]*)?(?:#[^\n\r\x85\u2028\u2029]*)?{_END}")
_BASENAME = re.compile(rf"([^/]*)/*{_END}")


def image_target(src: str) -> str:
    """``image_source`` of one value, for maps in Python."""
    path = _URL_PATH.match(src)
    name = _BASENAME.search(path[1])[1] if path else ""
    return f"../assets/{name}" if name else src


def copied_assets(index: DataFrame, links: DataFrame, arc: str) -> DataFrame:
    """Names to copy for an export: the archive's assets and those referenced that exist."""
    here = index.where(F.col("arc") == arc.upper()).select("basename_lc", basename(F.col("path")).alias("name"))
    asked = links.where("asset IS NOT NULL").select(F.lower("asset").alias("basename_lc")).distinct()
    wanted = here.where(extension(F.col("name")).isin(ASSET_EXTENSIONS)).select("basename_lc").union(asked).distinct()
    return here.join(wanted, "basename_lc", "left_semi").select("name")


def copied_wiring(index: DataFrame, links: DataFrame, wiring_arc: str, copy_all: bool = False) -> DataFrame:
    """Names of the paired archive to copy: all assets, or only those referenced."""
    here = index.where(F.col("arc") == wiring_arc.upper()).select("basename_lc", basename(F.col("path")).alias("name"))
    if copy_all:
        return here.where(extension(F.col("name")).isin(ASSET_EXTENSIONS)).select("name")
    asked = links.where("kind IN ('wiring', 'wiring_sheet')").select(F.lower("asset").alias("basename_lc")).distinct()
    return here.join(asked, "basename_lc", "left_semi").select("name")


def general(text: Column) -> Column:
    return or_default(text, "General")
