"""File triage over tables of content: types by magic, names, payload signs, strings, metadata times."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import small_batches
from .messages import DANGEROUS, MACRO

# Type, offset and magic bytes in hex; the first that fits wins.
MAGIC = [
    ("exe", 0, "4D5A"), ("elf", 0, "7F454C46"), ("macho", 0, "CFFAEDFE"), ("class", 0, "CAFEBABE"), ("pdf", 0, "25504446"), ("ole", 0, "D0CF11E0A1B11AE1"), ("zip", 0, "504B0304"), ("zip", 0, "504B0506"), ("rar", 0, "526172211A07"), ("7z", 0, "377ABCAF271C"),
    ("gz", 0, "1F8B"), ("bz2", 0, "425A68"), ("xz", 0, "FD377A585A00"), ("zst", 0, "28B52FFD"), ("tar", 257, "7573746172"), ("iso", 32769, "4344303031"), ("png", 0, "89504E470D0A1A0A"), ("jpg", 0, "FFD8FF"), ("gif", 0, "474946383761"), ("gif", 0, "474946383961"),
    ("bmp", 0, "424D"), ("tiff", 0, "49492A00"), ("tiff", 0, "4D4D002A"), ("ico", 0, "00000100"), ("mp3", 0, "494433"), ("wav", 8, "57415645"), ("avi", 8, "41564920"), ("webp", 8, "57454250"), ("mp4", 4, "66747970"), ("ogg", 0, "4F676753"),
    ("flac", 0, "664C6143"), ("rtf", 0, "7B5C727466"), ("lnk", 0, "4C00000001140200"), ("cab", 0, "4D534346"), ("evtx", 0, "456C6646696C6500"), ("pcap", 0, "D4C3B2A1"), ("pcap", 0, "A1B2C3D4"), ("pcapng", 0, "0A0D0D0A"), ("sqlite", 0, "53514C69746520666F726D61742033"), ("wasm", 0, "0061736D"),
]

# Endings that agree with a type found by magic.
COMPATIBLE = {"exe": ["exe", "dll", "scr", "sys", "com", "cpl", "ocx"], "zip": ["zip", "docx", "xlsx", "pptx", "docm", "xlsm", "pptm", "jar", "apk", "odt", "epub"], "ole": ["doc", "xls", "ppt", "msi", "msg"], "jpg": ["jpg", "jpeg"], "tiff": ["tif", "tiff"], "gz": ["gz", "tgz"], "mp4": ["mp4", "m4a", "mov"]}

# Signs of active payloads in latin-1 text.
PAYLOAD_SIGNS = {
    "vba_hook": r"(?i)\b(AutoOpen|Auto_Open|Document_Open|Workbook_Open|AutoExec|AutoClose)\b",
    "pdf_active": r"/(JavaScript|JS|OpenAction|AA|Launch|EmbeddedFile|RichMedia|XFA)\b",
    "pe_header": r"(?s)MZ.{58,512}PE\x00\x00",
    "injection_api": r"\b(VirtualAllocEx|WriteProcessMemory|CreateRemoteThread|NtUnmapViewOfSection|SetWindowsHookEx|QueueUserAPC)\b",
}
INTERESTING = r"(?i)\b[\w./:\\-]*(?:http|powershell|cmd\.exe|password|token|secret|wget|curl|registry|shell)[\w./:\\-]*"

# Macro names that run by themselves, keywords with what they show and their points, obfuscation with the least number of its matches, and commands.
MACRO_AUTO = r"(?i)\b(autoopen|auto_open|autoclose|auto_close|autoexec|auto_exec|autoexit|document_open|documentopen|document_close|workbook_open|workbookopen|workbook_activate|workbook_beforeclose|userform_initialize|userform_activate|app_workbookopen)\b"
MACRO_KEYWORDS = [
    ("shell", 15, r"(?i)\b(shell|wscript\.shell|shell\.application)\b"), ("com_object", 5, r"(?i)\b(createobject|getobject)\b"), ("http_client", 15, r"(?i)\b(msxml2\.xmlhttp|msxml2\.serverxmlhttp|winhttp\.winhttprequest)\b"),
    ("downloader", 15, r"(?i)\b(urldownloadtofile|urldownloadtofilea|urldownloadtofilew)\b"), ("environment", 5, r"(?i)\b(environ|environ\$)\b"), ("dynamic_call", 5, r"(?i)\b(callbyname)\b"),
    ("native_api", 10, r"(?i)\b(declare\s+(ptrsafe\s+)?sub|declare\s+(ptrsafe\s+)?function)\b"), ("native_import", 10, r"(?i)\blib\s+\"(kernel32|urlmon|shell32|user32|advapi32)\"\b"), ("mac_script", 5, r"(?i)\b(macscript|applescript)\b"), ("file_change", 5, r"(?i)\b(kill|filecopy|open\s+.*\s+for\s+binary)\b"),
]
MACRO_OBFUSCATION = [
    ("chr", 4, r"(?i)(?:chr|chrw|chrb)\s*\(\s*\d+\s*\)"), ("reversal", 4, r"(?i)\bstrreverse\s*\("), ("fragments", 4, r"(?i)(?:&\s*[\"'][\"']\s*&|[\"'][a-zA-Z0-9]{1,3}[\"']\s*&\s*[\"'][a-zA-Z0-9]{1,3}[\"'])"),
    ("xor", 1, r"(?i)\bxor\s+(?:&h[0-9a-f]+|\d+)\b"), ("conversion", 4, r"(?i)\b(?:hex|oct|asc|ascw)\s*\("),
]
MACRO_COMMAND = r"(?i)\b(powershell(?:\.exe)?|cmd(?:\.exe)?|wscript(?:\.exe)?|cscript(?:\.exe)?|mshta(?:\.exe)?|rundll32(?:\.exe)?|regsvr32(?:\.exe)?|certutil(?:\.exe)?|bitsadmin(?:\.exe)?)\b"

# Imported names by category and severity, points of a severity, and symbols of ELF files with their points.
IMPORTS = {
    ("injection", "CRITICAL"): ["virtualallocex", "virtualprotectex", "writeprocessmemory", "createremotethread", "createremotethreadex", "ntcreatethreadex", "queueuserapc", "setthreadcontext", "ntunmapviewofsection", "zwunmapviewofsection", "ntwritevirtualmemory"],
    ("injection", "HIGH"): ["virtualalloc", "virtualprotect", "readprocessmemory", "getthreadcontext", "resumethread"],
    ("keylogging", "HIGH"): ["setwindowshookexa", "setwindowshookexw", "getasynckeystate", "attachthreadinput"],
    ("keylogging", "MEDIUM"): ["getkeystate", "registerhotkey"],
    ("anti_debug", "HIGH"): ["checkremotedebuggerpresent", "ntqueryinformationprocess"],
    ("anti_debug", "MEDIUM"): ["isdebuggerpresent", "findwindowa", "findwindoww"],
    ("anti_debug", "LOW"): ["outputdebugstringa", "outputdebugstringw", "gettickcount", "queryperformancecounter", "timegettime"],
    ("dropper", "HIGH"): ["winexec", "shellexecuteexa", "shellexecuteexw", "createprocessasusera", "createprocessasuserw"],
    ("dropper", "MEDIUM"): ["shellexecutea", "shellexecutew", "createprocessa", "createprocessw"],
    ("network", "CRITICAL"): ["urldownloadtofilea", "urldownloadtofilew"],
    ("network", "HIGH"): ["internetopena", "internetopenw", "internetopenurla", "internetopenurlw", "httpopenrequesta", "httpopenrequestw", "httpsendrequesta", "httpsendrequestw"],
    ("network", "MEDIUM"): ["wsastartup", "socket", "connect"],
    ("persistence", "CRITICAL"): ["createservicea", "createservicew"],
    ("persistence", "HIGH"): ["regsetvalueexa", "regsetvalueexw", "openscmanagera", "adjusttokenprivileges"],
    ("persistence", "MEDIUM"): ["regcreatekeyexa", "regcreatekeyexw", "lookupprivilegevaluea", "lookupprivilegevaluew"],
    ("ransomware", "HIGH"): ["cryptencrypt", "bcryptencrypt"],
    ("ransomware", "MEDIUM"): ["cryptdecrypt", "cryptgenkey", "cryptacquirecontexta", "cryptacquirecontextw"],
}
IMPORT_POINTS = {"CRITICAL": 15, "HIGH": 8, "MEDIUM": 4, "LOW": 0}
SYMBOLS = {"ptrace": 25, "process_vm_writev": 35, "process_vm_readv": 20, "mprotect": 15, "memfd_create": 35, "execve": 15, "execveat": 20, "system": 15, "socket": 5, "connect": 5, "bind": 10, "fork": 5, "clone": 5, "dlopen": 10, "dlsym": 10}

# What a container holds that tells its type, and beginnings of markup and scripts.
ZIP_MEMBERS = [("docx", "word/"), ("xlsx", "xl/"), ("pptx", "ppt/"), ("apk", "AndroidManifest.xml"), ("jar", "META-INF/MANIFEST.MF"), ("epub", "mimetypeapplication/epub+zip"), ("odt", "mimetypeapplication/vnd.oasis.opendocument")]
OLE_STREAMS = [("doc", "WordDocument"), ("xls", "Workbook"), ("ppt", "PowerPoint Document"), ("msg", "__substg1.0_")]
HEIC_BRANDS = ["heic", "mif1", "msf1", "heix"]

# Media types that go with a type found by content.
MIME_TYPES = {"exe": ["application/x-msdownload", "application/vnd.microsoft.portable-executable", "application/x-dosexec"], "pdf": ["application/pdf"], "zip": ["application/zip", "application/x-zip-compressed"], "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"], "xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"], "png": ["image/png"], "jpg": ["image/jpeg", "image/jpg"], "gif": ["image/gif"], "gz": ["application/gzip", "application/x-gzip"], "html": ["text/html", "application/xhtml+xml"], "text": ["text/plain", "text/csv", "application/json"]}
ANY_MIME = ["application/octet-stream", ""]


def file_type(content: Column, custom: Sequence[tuple[str, int, str]] = ()) -> Column:
    """Type by magic bytes, a user's own (type, offset, hex) first; else `text` if the first 512 bytes are printable, else `unknown`."""
    b = content.cast("binary")
    out = F.when(F.decode(F.substring(b, 1, 512), "ISO-8859-1").rlike(r"^[\x09\x0A\x0D\x20-\x7E]+$"), "text").otherwise("unknown")
    for name, at, magic in reversed([*custom, *MAGIC]):
        out = F.when(F.hex(F.substring(b, at + 1, len(magic) // 2)) == magic.upper(), name).otherwise(out)
    return out


def inner_type(content: Column, kind: Column) -> Column:
    """The type of a container by what it holds (documents in zip and compound files, HEIC in mp4), PE only with its header, markup and scripts among text; else the kind as found."""
    text = F.decode(content.cast("binary"), "ISO-8859-1")
    out = kind
    for name, member in reversed(ZIP_MEMBERS):
        out = F.when((kind == "zip") & F.contains(text, F.lit(member)), name).otherwise(out)
    for name, stream in reversed(OLE_STREAMS):
        out = F.when((kind == "ole") & F.contains(text, F.lit("\x00".join(stream))), name).otherwise(out)
    head = F.lower(F.trim(F.substring(text, 1, 256)))
    markup = head.rlike(r"^(<html|<!doctype|<\?xml)")
    script = F.contains(head, F.lit("powershell")) | F.contains(head, F.lit("param(")) | head.rlike("^(@echo|set |rem )")
    out = F.when((kind == "mp4") & F.substring(text, 9, 4).isin(HEIC_BRANDS), "heic").otherwise(out)
    out = F.when((kind == "exe") & ~text.rlike(PAYLOAD_SIGNS["pe_header"]), "dos").otherwise(out)
    return F.when(kind.isin("text", "unknown") & markup, "html").when((kind == "text") & script, "script").otherwise(out)


def mime_mismatch(kind: Column, mime: Column) -> Column:
    """A media type that does not go with the type found; unknown types and octet streams go with all."""
    declared = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    fits = declared.isin(ANY_MIME) | ~kind.isin(list(MIME_TYPES))
    for name, types in MIME_TYPES.items():
        fits = fits | ((kind == name) & declared.isin(types))
    return ~fits


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def name_flags(name: Column, kind: Column | None = None) -> dict[str, Column]:
    """double_extension, direction_override, nul, dangerous, macro, and mismatch with the type found."""
    ext = extension(name)
    flags = {
        "double_extension": F.lower(name).rlike(r"\.(pdf|docx?|xlsx?|pptx?|txt|jpe?g|png|gif|zip|rtf)\.(" + "|".join(DANGEROUS) + r")$"),
        "direction_override": F.contains(name, F.lit("‮")), "nul": F.contains(name, F.lit("\x00")), "dangerous": ext.isin(DANGEROUS), "macro": ext.isin(MACRO),
    }
    if kind is not None:
        fits = ext == kind
        for k, endings in COMPATIBLE.items():
            fits = fits | ((kind == k) & ext.isin(endings))
        flags["mismatch"] = ~kind.isin("unknown", "text") & (ext != "") & ~fits
    return flags


def attachment_score(flags: dict[str, Column]) -> Column:
    points = {"mismatch": 50, "double_extension": 75, "direction_override": 85, "nul": 65, "dangerous": 45, "macro": 35}
    out = F.lit(0)
    for k, c in flags.items():
        out = F.greatest(out, F.when(c, points[k]).otherwise(0))
    return out


def safe_name(name: Column) -> Column:
    """Last path part without control and reserved characters, 255 at most; reserved device names get a leading underscore."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^.*[\\/]", ""), r"[\x00-\x1F\x7F<>:\"|?*‪-‮]", "_"), r"^[. ]+|[. ]+$", "")
    clean = F.when(F.upper(clean).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$"), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.when(F.length(clean) > 0, F.substring(clean, 1, 255)).otherwise("unnamed")


def payload_signs(df: DataFrame, content: str, keep: list[str]) -> DataFrame:
    text = F.decode(F.col(content).cast("binary"), "ISO-8859-1")
    found = F.filter(F.array(*(F.when(text.rlike(p), n) for n, p in PAYLOAD_SIGNS.items())), lambda x: x.isNotNull())
    return df.select(*keep, F.explode(found).alias("sign"))


def interesting_strings(text: Column, most: int = 15) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.regexp_extract_all(text, F.lit(INTERESTING), F.lit(0)))), 1, most)


def byte_entropy(df: DataFrame, content: str, keep: list[str], block: int | None = None) -> DataFrame:
    """entropy in bits a byte of the whole content, or of each block of so many bytes; blocks by numpy, batch by batch."""
    names = [*keep, "block", "entropy"]
    schema = ", ".join([*(f"`{c}` {dict(df.dtypes)[c]}" for c in keep), "block int", "entropy double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, blocks, out = [], [], []
            for i, v in enumerate(batch.column(content)):
                b = np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8)
                for k, start in enumerate(range(0, max(1, len(b)), block or max(1, len(b)))):
                    part = b[start : start + (block or max(1, len(b)))]
                    p = np.bincount(part, minlength=256) / max(1, len(part))
                    p = p[p > 0]
                    at.append(i)
                    blocks.append(k)
                    out.append(abs(round(float(-(p * np.log2(p)).sum()), 4)))
            kept = batch.select(keep).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(blocks, pa.int32()), pa.array(out, pa.float64())], names=names)

    return df.withColumn(content, F.col(content).cast("binary")).select(*keep, content).mapInArrow(run, schema)


def entropy_tier(entropy: Column) -> Column:
    return F.when(entropy >= 7.2, "ENCRYPTED").when(entropy >= 6.8, "PACKED").when(entropy >= 5.0, "CODE").otherwise("PLAIN")


def _printable(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Printable runs of chunks, a chunk in memory at a time and batches of some 256 KB out."""
    import re

    kinds = [("ascii", re.compile(rb"[\x20-\x7e]{%d,}" % least)), ("utf-16le", re.compile(rb"(?:[\x20-\x7e]\x00){%d,}" % least))]
    rows, held = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["image_id", "offset", "encoding", "value"])

    for batch in batches:
        for image, off, data in zip(batch.column("image_id"), batch.column("chunk_off"), batch.column("bytes")):
            if not data.is_valid:
                continue
            image, off, data = image.as_py(), off.as_py(), data.as_buffer()
            for encoding, pattern in kinds:
                for m in pattern.finditer(data):
                    rows.append((image, off + m.start(), encoding, m[0].decode(encoding)))
                    held += 128 + len(m[0])
                    if held >= 1 << 18:
                        yield out()
                        rows, held = [], 0
    if rows:
        yield out()


def strings(chunks: DataFrame, least: int = 4) -> DataFrame:
    """image_id, offset, encoding, value, length: printable runs of chunks (image_id, chunk_off, bytes), ASCII and UTF-16LE.

    Chunks may overlap; pieces of one image and encoding that overlap or touch are one run, however many chunks it
    spans. Chunks of one image that are cut inside a run should overlap by 4 * least bytes, as shorter pieces are not seen.
    """

    small_batches(chunks.sparkSession)
    found = chunks.select(F.col("image_id").cast("string").alias("image_id"), "chunk_off", "bytes").mapInArrow(lambda batches: _printable(batches, least), "image_id string, offset long, encoding string, value string")
    unit = F.when(F.col("encoding") == "ascii", 1).otherwise(2)
    w = Window.partitionBy("image_id", "encoding").orderBy("offset", "_end")
    ended = found.withColumn("_end", F.col("offset") + F.length("value") * unit).withColumn("_before", F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.col("_before").isNull() | (F.col("offset") > F.col("_before"))
    runs = ended.withColumn("_start", F.max(F.when(begins, F.col("offset"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.greatest(F.lit(0), ((F.least("_before", "_end") - F.col("offset")) / unit).cast("int"))  # characters that pieces before have
    runs = runs.withColumn("value", F.when(begins, F.col("value")).otherwise(F.col("value").substr(known + 1, F.length("value"))))
    pieces = F.array_sort(F.collect_list(F.when(F.length("value") > 0, F.struct("offset", "_end", "value"))))
    one = runs.groupBy("image_id", "encoding", F.col("_start").alias("offset")).agg(F.array_join(F.transform(pieces, lambda x: x["value"]), "").alias("value"))
    return one.select("image_id", "offset", "encoding", "value", F.length("value").alias("length"))


def string_statistics(found: DataFrame, key: str = "image_id", sizes: DataFrame | None = None) -> DataFrame:
    """Counts and lengths of strings; with sizes (key, bytes) also printable_ratio, the characters' share of the bytes."""
    if sizes is not None:
        chars = string_statistics(found, key).join(found.groupBy(key).agg(F.sum("length").alias("_chars")), key)
        return chars.join(sizes.select(key, "bytes"), key).withColumn("printable_ratio", F.round(F.when(F.col("bytes") > 0, F.col("_chars") / F.col("bytes")).otherwise(0.0), 4)).drop("_chars", "bytes")
    return found.groupBy(key).agg(F.count("*").alias("strings"), F.count_if(F.col("encoding") == "ascii").alias("ascii"), F.count_if(F.col("encoding") != "ascii").alias("wide"), (F.floor(F.avg("length") * 100 + 0.5) / 100).alias("mean_length"), F.max("length").alias("longest"))


def chunked(images: DataFrame, size: int, overlap: int) -> DataFrame:
    """image_id, chunk_off, bytes: pieces of images (image_id, content) of `size` bytes that share `overlap` with the next."""
    n = F.octet_length("content")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return images.withColumn("_off", F.explode(starts)).select("image_id", F.col("_off").cast("long").alias("chunk_off"), F.col("content").substr(F.col("_off") + 1, F.lit(size)).alias("bytes"))


def api_score(found: DataFrame, key: str = "image_id") -> DataFrame:
    """Points of imported names among strings (key, value), each once: by severity, and 15, 12 and 15 for injection, keylogging, and network with dropper names; 100 at most."""
    rows = [(v, category, IMPORT_POINTS[severity]) for (category, severity), values in IMPORTS.items() for v in values]
    names = found.sparkSession.createDataFrame(rows, "value string, category string, points int")
    each = found.withColumn("value", F.lower("value")).select(key, "value").join(F.broadcast(names), "value").distinct()
    out = each.groupBy(key).agg(F.sum("points").alias("_p"), F.count("*").alias("names"), F.sort_array(F.collect_set("category")).alias("categories"))
    has = lambda c: F.array_contains("categories", c)
    extra = F.when(has("injection"), 15).otherwise(0) + F.when(has("keylogging"), 12).otherwise(0) + F.when(has("network") & has("dropper"), 15).otherwise(0)
    return out.withColumn("score", F.least(F.lit(100), F.col("_p") + extra).cast("int")).drop("_p")


def symbol_score(found: DataFrame, key: str = "image_id") -> DataFrame:
    """Points of ELF symbols that strings (key, value) hold, each once, 100 at most. One projection: the table is literal."""
    held = found.groupBy(key).agg(*(F.bool_or(F.contains("value", F.lit(s))).alias(s) for s in SYMBOLS))
    points = sum((F.when(F.col(s), p).otherwise(0) for s, p in SYMBOLS.items()), F.lit(0))
    names = F.array_compact(F.array(*(F.when(F.col(s), s) for s in SYMBOLS)))
    return held.select(key, F.least(F.lit(100), points).alias("score"), names.alias("symbols"))


def macro_report(df: DataFrame, code: str, keep: list[str]) -> DataFrame:
    """Score and verdict of macro source: 15 for any code, 25 self-starting, 30 commands, 20 links or addresses, 20 obfuscation, and its keywords; MALICIOUS at 60, SUSPICIOUS at 30."""
    c = F.coalesce(F.col(code), F.lit(""))
    auto = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(MACRO_AUTO), F.lit(0)), F.lower)))
    keywords = F.array_compact(F.array(*(F.when(c.rlike(p), n) for n, _, p in MACRO_KEYWORDS)))
    hidden = F.array_compact(F.array(*(F.when(F.regexp_count(c, F.lit(p)) >= least, n) for n, least, p in MACRO_OBFUSCATION)))
    commands = F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(MACRO_COMMAND), F.lit(0)), F.lower)))
    reach = c.rlike(r"(?i)https?://[a-z0-9]") | c.rlike(r"\b(?!127\.|0\.)(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b")
    points = sum((F.when(c.rlike(p), n).otherwise(0) for _, n, p in MACRO_KEYWORDS), F.lit(0))
    out = df.select(*keep, auto.alias("auto"), keywords.alias("keywords"), hidden.alias("obfuscation"), commands.alias("commands"), reach.alias("reaches_out"), points.alias("_p"), (F.length(F.trim(c)) > 0).alias("_any"))
    score = F.when(F.col("_any"), 15).otherwise(0) + F.when(F.size("auto") > 0, 25).otherwise(0) + F.when(F.size("commands") > 0, 30).otherwise(0) + F.when(F.col("reaches_out"), 20).otherwise(0) + F.when(F.size("obfuscation") > 0, 20).otherwise(0)
    out = out.withColumn("score", F.least(F.lit(100), score + F.col("_p"))).drop("_p", "_any")
    return out.withColumn("verdict", F.when(F.col("score") >= 60, "MALICIOUS").when(F.col("score") >= 30, "SUSPICIOUS").otherwise("BENIGN"))


# Points of an attachment's findings.
ATTACHMENT_POINTS = {"dangerous": 35, "mismatch": 40, "listed": 50, "macro": 35, "pdf": 30, "executable": 45}
RULE_POINTS = {"CRITICAL": 50, "HIGH": 35}


def attachment_analysis(parts: DataFrame, listed: DataFrame | None = None, rules: DataFrame | None = None, keep: tuple[str, ...] = ("message_key", "index")) -> DataFrame:
    """Score and level of attachments (keep, filename, content). listed: value (digests in lower case); rules: keep, severity (rules that hit).

    Points: dangerous ending 35, type not of its ending 40, each listed digest 50, rules 50, 35 or 20 by severity, macro hooks 35, active PDF 30,
    program or injection names 45; MALICIOUS at 60, with a listed digest or a rule.
    """
    kind = file_type(F.col("content"))
    text = F.decode(F.col("content").cast("binary"), "ISO-8859-1")
    flags = name_flags(F.col("filename"), kind)
    marks = {"dangerous": flags["dangerous"], "mismatch": flags["mismatch"], "macro": text.rlike(PAYLOAD_SIGNS["vba_hook"]), "pdf": (kind == "pdf") & text.rlike(PAYLOAD_SIGNS["pdf_active"]), "executable": text.startswith("MZ") | text.rlike(PAYLOAD_SIGNS["injection_api"])}
    out = parts.select(*keep, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in marks.items()), F.array(F.md5("content"), F.sha1("content"), F.sha2("content", 256)).alias("_d"))
    if listed is not None:
        hits = out.select(*keep, F.explode("_d").alias("value")).join(listed.select("value").distinct(), "value").groupBy(*keep).agg(F.count("*").alias("listed"))
        out = out.join(hits, list(keep), "left")
    else:
        out = out.withColumn("listed", F.lit(0))
    if rules is not None:
        points = F.when(F.col("severity") == "CRITICAL", RULE_POINTS["CRITICAL"]).when(F.col("severity") == "HIGH", RULE_POINTS["HIGH"]).otherwise(20)
        out = out.join(rules.groupBy(*keep).agg(F.sum(points).alias("_r")), list(keep), "left")
    else:
        out = out.withColumn("_r", F.lit(None).cast("long"))
    score = sum((F.when(F.col(n), ATTACHMENT_POINTS[n]).otherwise(0) for n in marks), F.coalesce("listed", F.lit(0)) * ATTACHMENT_POINTS["listed"] + F.coalesce("_r", F.lit(0)))
    out = out.withColumn("score", F.least(F.lit(100), score).cast("int"))
    level = F.when((F.col("score") >= 60) | (F.coalesce("listed", F.lit(0)) > 0) | F.col("_r").isNotNull(), "MALICIOUS").when((F.col("score") >= 20) | F.col("dangerous") | F.col("mismatch"), "SUSPICIOUS").otherwise("BENIGN")
    return out.withColumn("listed", F.coalesce("listed", F.lit(0))).withColumn("level", level).drop("_d", "_r")


def attachment_report(analysis: DataFrame, key: str = "message_key") -> DataFrame:
    """Per message: attachments, the highest score, and the worst level."""
    rank = F.when(F.col("level") == "MALICIOUS", 2).when(F.col("level") == "SUSPICIOUS", 1).otherwise(0)
    out = analysis.groupBy(key).agg(F.count("*").alias("attachments"), F.max("score").alias("score"), F.max(rank).alias("_r"))
    return out.withColumn("level", F.when(F.col("_r") == 2, "MALICIOUS").when(F.col("_r") == 1, "SUSPICIOUS").otherwise("BENIGN")).drop("_r")


def pdf_findings(content: Column) -> dict[str, Column]:
    """Flags of active content, producer and creator of a PDF's bytes."""
    text = F.decode(content.cast("binary"), "ISO-8859-1")
    one = lambda k: F.nullif(F.regexp_extract(text, rf"/{k}\s*\(([^)]*)\)", 1), F.lit(""))
    tokens = ["JavaScript", "JS", "OpenAction", "AA", "Launch", "EmbeddedFile", "RichMedia", "XFA"]
    return {"is_pdf": F.startswith(text, F.lit("%PDF-")), "flags": F.array_compact(F.array(*(F.when(text.rlike(rf"/{t}\b"), t) for t in tokens))), "producer": one("Producer"), "creator": one("Creator")}


def time_anomalies(metadata: DataFrame, now: Column) -> DataFrame:
    """Documents (created, modified) dated before 1980, over a day ahead, or modified before they were made."""
    early = F.least("created", "modified") < F.lit("1980-01-01").cast("timestamp")
    ahead = F.greatest("created", "modified") > now + F.expr("INTERVAL 1 DAY")
    found = F.filter(F.array(F.when(early, "BEFORE_1980"), F.when(ahead, "FUTURE"), F.when(F.col("modified") < F.col("created"), "MODIFIED_BEFORE_CREATED")), lambda x: x.isNotNull())
    return metadata.withColumn("anomaly", F.explode(found))
