"""Text forms and validity of names, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64url(data: Column) -> Column:
    """Base64 in the URL alphabet, without padding or line breaks."""
    return F.rtrim(F.translate(F.base64(data), "+/\r\n", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    """Strict inverse; null if the text is not canonical."""
    raw = F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))
    return F.when(text.rlike("^[A-Za-z0-9_-]*$") & (base64url(raw) == text), raw)


def digest_text(digest: Column, algorithm: str = "blake3") -> Column:
    return F.concat(F.lit(f"{algorithm}-"), base64url(digest))


def key_text(namespace: Column, native_id: Column) -> Column:
    return F.concat(namespace, F.lit(":"), base64url(native_id))


def parse_key(text: Column) -> Column:
    """STRUCT<namespace, native_id> of a key's text form; null if it is not valid."""
    parts = F.split(text, ":", -1)
    ns, raw = F.get(parts, 0), from_base64url(F.get(parts, 1))
    return F.when((F.size(parts) == 2) & valid_namespace(ns) & raw.isNotNull() & (F.octet_length(raw) <= 128), F.struct(ns.alias("namespace"), raw.alias("native_id")))


def valid_namespace(name: Column) -> Column:
    return name.rlike(r"^[a-z][a-z0-9-]*(\.[a-z][a-z0-9-]*)*\.v[0-9]+\z") & (F.octet_length(name) <= 64)


def valid_root_name(name: Column) -> Column:
    """1 to 1024 bytes; components of 1 to 255 bytes, not "." or ".."; no control characters."""
    component = lambda s: (s != "") & (s != ".") & (s != "..") & (F.octet_length(s) <= 255)
    return F.octet_length(name).between(1, 1024) & F.forall(F.split(name, "/", -1), component) & ~name.rlike(r"[\x00-\x1f\x7f]")


def valid_component(name: Column) -> Column:
    return F.octet_length(name).between(1, 255) & ~name.isin(".", "..") & ~name.contains("/") & ~name.contains("\0")


def valid_symlink(target: Column) -> Column:
    return F.octet_length(target).between(1, 4095) & ~target.contains("\0")


def symlink_escapes(components: Column, target: Column) -> Column:
    """Whether a link standing at a path leads out of the tree at any step, or is absolute."""
    step = lambda d, c: F.when(d < 0, d).when(c == "..", d - 1).when(c.isin("", "."), d).otherwise(d + 1)
    depth = F.aggregate(F.split(target, "/", -1), F.size(components) - 1, step)
    return target.startswith("/") | (depth < 0)


def valid_git_ref(name: Column) -> Column:
    """Canonical full reference names."""
    bad = r"(^[^/]*$)|(^/)|(/$)|(//)|(\.\.)|(\.$)|(@\{)|(^@$)|([\x00-\x20\x7f~^:?*\[\\])|((^|/)\.)|(\.lock(/|$))"
    return name.startswith("refs/") & ~name.rlike(bad)


def valid_windows_name(name: Column) -> Column:
    reserved = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
    return ~name.rlike(reserved) & ~name.rlike(r'[<>:"/\\|?*\x00-\x1f]') & ~name.rlike(r"[. ]$")


def links_in_order(links: Column) -> Column:
    """Whether an array is strictly ascending."""
    return links == F.array_sort(F.array_distinct(links))


def last_use(value: Column) -> Column:
    """Nanoseconds of a retention value: byte 1, then eight bytes big-endian; null if it has another form."""
    ok = (F.octet_length(value) == 9) & (F.hex(F.substring(value, 1, 1)) == "01")
    return F.when(ok, F.conv(F.hex(F.substring(value, 2, 8)), 16, 10).cast("decimal(20,0)"))


def pressured(used: Column, total: Column, percent: int = 80) -> Column:
    """Whether a disk is used to a threshold; one without capacity never is."""
    return (total > 0) & (used.cast("decimal(38,0)") * 100 >= total.cast("decimal(38,0)") * percent)


def scope_name(text: Column, default: str) -> Column:
    """STRUCT<scope, name> of SCOPE:NAME; without a colon, or with a leading slash, the name is literal."""
    at = F.instr(text, ":")
    literal = (at == 0) | text.startswith("/")
    return F.struct(F.when(literal, F.lit(default)).otherwise(F.substring(text, F.lit(1), at - 1)).alias("scope"), F.when(literal, text).otherwise(F.substring(text, at + 1, F.length(text))).alias("name"))


def host_port(text: Column) -> Column:
    """STRUCT<host, port>; addresses in brackets may hold colons."""
    host = F.regexp_extract(text, r"^(\[[^\]]+\]|[^:\[\]]+)(?::([0-9]{1,5}))?\z", 1)
    port = F.regexp_extract(text, r"^(\[[^\]]+\]|[^:\[\]]+)(?::([0-9]{1,5}))?\z", 2)
    return F.when(host != "", F.struct(F.regexp_replace(host, r"^\[|\]$", "").alias("host"), F.when(port != "", port.cast("int")).alias("port")))


def git_object_digest(kind: str, body: Column, algorithm: str = "sha1") -> Column:
    """Hexadecimal id of an object: the hash of its kind, size and body."""
    framed = F.concat(F.lit(f"{kind} ").cast("binary"), F.octet_length(body).cast("string").cast("binary"), F.unhex(F.lit("00")), body)
    return F.sha1(framed) if algorithm == "sha1" else F.sha2(framed, 256)


def git_commit_links(body: Column) -> Column:
    """STRUCT<tree, parents> of a commit's header."""
    head = F.split_part(body, F.lit("\n\n"), F.lit(1))
    return F.struct(F.regexp_extract(head, r"(?m)\Atree ([0-9a-f]+)$", 1).alias("tree"), F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)$"), F.lit(1)).alias("parents"))


def git_tag_links(body: Column) -> Column:
    """STRUCT<object, kind> of a tag's header."""
    head = F.split_part(body, F.lit("\n\n"), F.lit(1))
    return F.struct(F.regexp_extract(head, r"(?m)\Aobject ([0-9a-f]+)$", 1).alias("object"), F.regexp_extract(head, r"(?m)^type ([a-z]+)$", 1).alias("kind"))


def measurements(data: Column) -> Column:
    """STRUCT of the digests a payload is measured by in one pass."""
    return F.struct(F.sha2(data, 256).alias("sha256"), F.sha1(data).alias("sha1"), F.md5(data).alias("md5"), F.sha2(data, 512).alias("sha512"), F.octet_length(data).cast("long").alias("size"))
