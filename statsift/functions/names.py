"""Expressions over accessions, file names, URLs and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes.
DATA_SUFFIXES = (".tsv", ".txt", ".csv", ".tab", ".ma", ".assoc", ".meta", ".tbl", ".linear", ".logistic", ".sumstats", ".gwas", ".regenie", ".out")
PACKED_SUFFIXES = (".gz", ".bgz", ".zip", ".bz2", ".xz", ".zst", ".tar")
SHEET_SUFFIXES = (".xlsx", ".xls")
OTHER_SUFFIXES = ("-meta.yaml", ".yaml", ".yml", ".json", ".pdf", ".png", ".jpg", ".jpeg", ".html", ".htm", ".md5", ".xlsx", ".doc", ".docx", ".r", ".py", ".log")
OTHER_NAMES = ("md5sum.txt", "readme.txt", "readme.md", "readme", "license", "checksums.txt")
# Hosts that serve the same paths over https.
MIRRORED_HOSTS = ("ebi.ac.uk", "ncbi.nlm.nih.gov", "nih.gov", "sanger.ac.uk")


def ends_with_any(name: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether a lower-cased name ends with one of the suffixes."""
    return F.coalesce(F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"), F.lit(False))


def is_accession(value: Column) -> Column:
    """A study accession: GCST and four digits or more."""
    return F.coalesce(value.rlike(r"(?i)^GCST\d{4,}$"), F.lit(False))


def accession_block(accession: Column) -> Column:
    """The thousands range whose folder holds an accession; digits keep their width, six at least."""
    digits = F.regexp_extract(accession, r"(?i)^GCST(\d+)$", 1)
    number = digits.try_cast("bigint")
    low = F.floor((number - 1) / 1000) * 1000 + 1
    width = F.greatest(F.length(digits), F.lit(6))
    padded = lambda n: F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(n))), n)  # noqa: E731  (lpad would cut what is wider)
    text = lambda n: padded(n.cast("string"))
    return F.when(digits != "", F.concat(F.lit("GCST"), text(low), F.lit("-GCST"), text(low + 999)))


def parse_size_label(label: Column) -> Column:
    """Bytes from a directory listing's ``1.2G``; a dash is unknown."""
    number = F.regexp_extract(label, r"^\s*([0-9]*\.?[0-9]+)\s*([KMGT]?)\s*$", 1)
    unit = F.regexp_extract(F.upper(label), r"^\s*([0-9]*\.?[0-9]+)\s*([KMGT]?)\s*$", 2)
    number = F.when(number == "", F.regexp_extract(F.upper(label), r"^\s*([0-9]*\.?[0-9]+)\s*([KMGT]?)\s*$", 1)).otherwise(number)
    factor = F.when(unit == "K", 1024.0).when(unit == "M", 1024.0**2).when(unit == "G", 1024.0**3).when(unit == "T", 1024.0**4).otherwise(1.0)
    return F.when(number != "", (number.try_cast("double") * factor).cast("bigint"))


def human_size(size: Column) -> Column:
    """Bytes with a unit, for people."""
    out = F.when(size < 1024, F.format_string("%d B", size.cast("bigint")))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = out.when(size < 1024 ** (power + 1), F.format_string(f"%.2f {unit}", size / float(1024**power)))
    return out.when(size.isNotNull(), F.format_string("%.2f TB", size / float(1024**4))).otherwise("unknown")


def strip_packed(name: Column) -> Column:
    """A name without its compression suffix."""
    return F.regexp_replace(name, r"(?i)(\.tar\.gz|\.tgz|\.gz|\.bgz|\.zip|\.bz2|\.xz|\.zst|\.tar)$", "")


def inner_extension(name: Column) -> Column:
    """The lower-cased extension below any compression suffix."""
    return F.lower(F.regexp_extract(strip_packed(name), r"(\.[^./]+)$", 1))


def is_tabular(name: Column) -> Column:
    return inner_extension(name).isin(*DATA_SUFFIXES)


def is_spreadsheet(name: Column) -> Column:
    return inner_extension(name).isin(*SHEET_SUFFIXES)


def delimiter_for(name: Column) -> Column:
    """The delimiter that an extension suggests."""
    return F.when(inner_extension(name) == ".csv", ",").when(inner_extension(name).isin(".tsv", ".tab", ".regenie"), "\t")


def file_kind(name: Column) -> Column:
    """directory, checksum, readme, metadata, data or auxiliary."""
    lower = F.lower(name)
    base = F.element_at(F.split(lower, "/"), -1)
    packed = lower != F.lower(strip_packed(name))
    sums = F.contains(lower, F.lit("md5")) | F.contains(lower, F.lit("checksum"))
    return (
        F.when(F.endswith(lower, F.lit("/")), "directory")
        .when(base.isin(*OTHER_NAMES) | base.startswith("readme"), F.when(sums, "checksum").otherwise("readme"))
        .when(F.endswith(lower, F.lit("-meta.yaml")), "metadata")
        .when(ends_with_any(lower, OTHER_SUFFIXES), "auxiliary")
        .when(ends_with_any(strip_packed(lower), DATA_SUFFIXES) | packed, "data")
        .otherwise("auxiliary")
    )


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def file_name(url: Column) -> Column:
    """The last part of a URL's path."""
    return F.regexp_extract(url_path(url), r"([^/]*)$", 1)


def is_direct_url(value: Column) -> Column:
    """An http, https or ftp address with a host."""
    return F.coalesce(url_scheme(value).isin("http", "https", "ftp") & (url_host(value) != ""), F.lit(False))


def normalised_url(url: Column) -> Column:
    """ftp becomes https where the host is known to mirror it, else NULL; other addresses stay."""
    host = url_host(url)
    mirrored = F.lit(False)
    for known in MIRRORED_HOSTS:
        mirrored = mirrored | (host == known) | F.endswith(host, F.lit("." + known))
    return F.when(url_scheme(url) != "ftp", url).when(mirrored, F.regexp_replace(url, r"(?i)^\s*ftp://", "https://"))


def share_url(url: Column) -> Column:
    """A Dropbox page's address as its download's: ``dl=1``; other addresses stay."""
    dropbox = (url_host(url) == "dropbox.com") | F.endswith(url_host(url), F.lit(".dropbox.com"))
    bare = F.regexp_replace(F.regexp_replace(url, r"([?&])dl=[^&#]*&?", "$1"), r"[?&]$", "")
    return F.when(dropbox, F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("dl=1"))).otherwise(url)


def input_kind(value: Column) -> Column:
    """url, accession, or NULL for what is neither (a path, if such are allowed)."""
    return F.when(is_direct_url(value), "url").when(is_accession(F.trim(value)), "accession")


def safe_file_name(name: Column) -> Column:
    """A name that any file system takes."""
    plain = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", "")
    reserved = F.upper(F.regexp_extract(plain, r"^([^.]*)", 1)).rlike("^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(plain == "", "download").when(reserved, F.concat(F.lit("_"), plain)).otherwise(plain)


def status_category(status: Column) -> Column:
    """The failure category of an HTTP status."""
    return (
        F.when(status == 403, "http_403").when(status == 404, "http_404").when(status == 410, "api_deprecated")
        .when(status.isin(408, 504), "network_timeout").when(status == 416, "range_not_supported").when(status >= 400, "http_error")
    )


def content_length(content_range: Column, length: Column) -> Column:
    """The whole size: the total of Content-Range before Content-Length."""
    total = F.regexp_extract(content_range, r"/(\d+)\s*$", 1).try_cast("bigint")
    return F.coalesce(total, F.trim(length).try_cast("bigint"))


def supports_ranges(accept_ranges: Column) -> Column:
    return F.coalesce(F.lower(F.trim(accept_ranges)) == "bytes", F.lit(False))
