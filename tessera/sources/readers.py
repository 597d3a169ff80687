"""File sources (S1-S7, S11, S12) on Spark readers.

* CSV: ``spark.read.csv`` with header; pandas' NA tokens become null in one projection,
  then one aggregate decides every column's type.
* TXT: whitespace-separated (the CSV reader has no regex separator): ``read.text`` ->
  ``split(trim(value), '\\s+')`` -> typed by a one-pass castability check.
* Encoding detection runs as a Spark job: every file's bytes are strict-decoded against the
  candidate list, each file for itself and whole (``detect_encodings`` looks at the first
  200 000 bytes only); files are then read with that encoding. No chardet in this
  environment, so the candidate order (UTF-8 with/without BOM, then the CJK code pages)
  decides; latin-1 is the last resort.
* Excel (.xlsx) and SAS: ``binaryFile`` -> per-file decoder in ``mapInPandas``.
"""

from __future__ import annotations

import csv
import io
import os
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# pandas' default missing-value tokens.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# Encodings tried in order after detection, and the CJK name remapping.
FALLBACK_ENCODINGS = ["utf-8", "utf-8-sig", "cp950", "big5", "gb18030", "euc_jp", "shift_jis"]
CJK_MAP = {"big5": "cp950", "big5hkscs": "cp950", "big5tw": "cp950", "gb2312": "gb18030", "gb18030": "gb18030",
           "gbk": "gb18030", "euccn": "gb18030", "eucjp": "euc_jp", "euckr": "euc_kr", "shiftjis": "shift_jis",
           "iso2022jp": "iso2022_jp"}
SAMPLE_BYTES = 200_000
MAX_COLUMNS = 200
SUPPORTED = (".csv", ".txt", ".xlsx", ".xls", ".sas7bdat")

# Java charset names Spark's CSV reader understands for the Python codec names
_JAVA_CHARSET = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "cp950": "x-windows-950", "big5": "Big5",
                 "gb18030": "GB18030", "euc_jp": "EUC-JP", "shift_jis": "Shift_JIS", "latin-1": "ISO-8859-1",
                 "euc_kr": "EUC-KR", "iso2022_jp": "ISO-2022-JP"}


def detect_encoding_bytes(sample: bytes) -> str:
    """First candidate that strictly decodes the sample (BOM first), else latin-1."""
    if sample.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    for enc in FALLBACK_ENCODINGS:
        try:
            # a multi-byte character may be cut at the sample end: ignore a short tail
            sample.decode(enc)
            return enc
        except UnicodeDecodeError as e:
            if e.start >= len(sample) - 4 and enc != "utf-8-sig":
                return enc
            continue
    return "latin-1"


def detect_encodings(spark: SparkSession, path_glob: str) -> DataFrame:
    """S3: (path, encoding) for every file matched, decided inside Spark tasks."""
    files = spark.read.format("binaryFile").load(path_glob).select("path", F.substring("content", 1, SAMPLE_BYTES).alias("head"))

    def detect(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "encoding": [detect_encoding_bytes(bytes(b)) for b in pdf["head"]]})

    return files.mapInPandas(detect, "path string, encoding string")


def _null_tokens(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(c.isin(NA_TOKENS), F.lit(None)).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


_INT = r"^\s*[+-]?\d+\s*$"
_FLOAT = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?inf(inity)?\s*$"
# The words pandas reads as booleans.
_BOOL = ["True", "TRUE", "true", "False", "FALSE", "false"]


def _typed(wide: DataFrame) -> DataFrame:
    """All-string columns typed by one aggregate, missing tokens being null already: long,
    double, boolean or string, whichever every value of a column fits (all null: double)."""
    quoted = [F.col(f"`{n}`") for n in wide.columns]
    fits = [(F.count_if(c.isNotNull() & ~(c.rlike(_INT) & F.trim(c).try_cast("long").isNotNull())),
             F.count_if(c.isNotNull() & ~c.rlike(_FLOAT)), F.count_if(c.isNotNull() & ~c.isin(_BOOL)),
             F.count(c)) for c in quoted]
    counts = wide.agg(*[e.alias(f"{k}{i}") for i, four in enumerate(fits) for k, e in zip("ldbn", four)]).first()
    out = []
    for i, (name, c) in enumerate(zip(wide.columns, quoted)):
        if counts[f"n{i}"] == 0:
            typed = F.lit(None).cast("double")
        elif counts[f"l{i}"] == 0:
            typed = F.trim(c).try_cast("long")
        elif counts[f"d{i}"] == 0:
            typed = F.trim(c).try_cast("double")
        elif counts[f"b{i}"] == 0:
            typed = F.lower(c) == "true"
        else:
            typed = c
        out.append(typed.alias(name))
    return wide.select(*out)


def _csv_strings(spark: SparkSession, paths, encoding: str, delimiter: str, multi_line: bool) -> DataFrame:
    """Files of one encoding with every column as a string."""
    if encoding not in ("utf-8", "utf-8-sig", "latin-1"):
        # Spark accepts Big5 / GB18030 / EUC-JP / Shift_JIS / cp950 only with this flag; it is read
        # when a file is opened, so it stays set while the frame is in use
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    r = (spark.read.option("header", True).option("inferSchema", False).option("encoding", _JAVA_CHARSET.get(encoding, encoding))
         .option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
         .option("enforceSchema", False).option("maxColumns", 1_000_000).csv(paths))
    if r.columns and r.columns[0].startswith("\ufeff"):
        r = r.withColumnRenamed(r.columns[0], r.columns[0].lstrip("\ufeff"))
    return r


def file_encodings(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """S3 over whole files: (path, encoding) of every file, the first candidate under which all of its
    bytes decode strictly and its header has at most MAX_COLUMNS columns; latin-1 if none does.
    Tasks decode the lines they hold (no candidate has a line end within a character), so a
    large file is spread over tasks, and each file is judged for itself. The line reader drops
    a byte order mark, so a marked file counts as utf-8."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("_metadata.file_path").alias("file"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"),
                                         (F.col("_metadata.file_block_start") == 0).alias("begins"))

    def fits(enc: str, data: bytes, header: bytes | None) -> bool:
        try:
            data.decode(enc)
            return header is None or len(next(csv.reader([header.decode(enc)], delimiter=delimiter), [])) <= MAX_COLUMNS
        except (UnicodeDecodeError, csv.Error):
            return False

    def judge(batches):
        seen = set()
        for batch in batches:
            at, lines_of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            begins, rows, i = batch.column(2).to_pylist(), [], 0
            while i < len(at):
                j = i
                while j < len(at) and at[j] == at[i]:
                    j += 1
                header = lines_of[i] if begins[i] and at[i] not in seen else None
                seen.add(at[i])
                data = b"\n".join(lines_of[i:j])
                mask = sum(fits(enc, data, header) << k for k, enc in enumerate(FALLBACK_ENCODINGS))
                rows.append((at[i], mask))
                i = j
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32())], names=["file", "mask"])

    masks = lines.mapInArrow(judge, "file string, mask int").groupBy("file").agg(F.bit_and("mask").alias("mask"))
    first = F.coalesce(*(F.when(F.col("mask").bitwiseAND(1 << k) > 0, enc) for k, enc in enumerate(FALLBACK_ENCODINGS)),
                       F.when(F.col("mask").isNull(), FALLBACK_ENCODINGS[0]), F.lit("latin-1"))
    return files.join(masks, "file", "left").select("path", first.alias("encoding"))


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None,
             infer: bool = True, multi_line: bool = True) -> DataFrame:
    """S1 (+S3, S4): header CSV; an explicit encoding bypasses detection. Every file is read in the
    encoding that its own bytes decode in (``file_encodings``); files of one encoding are read
    together and all are united by column name. Missing tokens become null before columns are
    typed. Quoted values may hold quotes and line ends (``multi_line``; turn it off to let
    Spark split large files that have none)."""
    if encoding:
        groups = [(path, encoding)]
    else:
        found = file_encodings(spark, path, delimiter or ",").groupBy("encoding").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
        groups = [(r["paths"] if len(found) > 1 else path, r["encoding"]) for r in sorted(found, key=lambda r: r["encoding"])]
    out = None
    for paths, enc in groups:
        part = _csv_strings(spark, paths, enc, delimiter or ",", multi_line)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"could not read {path}: no files")
    out = _null_tokens(out)
    return _typed(out) if infer else out


def read_txt(spark: SparkSession, path: str, sep_regex: str = r"\s+", encoding: str = "utf-8") -> DataFrame:
    """Whitespace-separated text with a header line, typed by castability. The first
    line of every file is its header; later lines equal to it are data. Missing fields at
    the end of a line are null."""
    # the text reader hands over each line's bytes as they are
    value = F.col("value")
    if encoding not in ("utf-8", "utf-8-sig"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        value = F.decode(value.cast("binary"), _JAVA_CHARSET.get(encoding, encoding))
    lines = spark.read.text(path).select(
        F.regexp_replace(value, r"^[\s\uFEFF]+|\s+$", "").alias("value"), F.monotonically_increasing_id().alias("at"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where(F.length("value") > 0)
    # ids rise within a split, so a file's header has the least id of its first split
    headers = lines.where(F.col("block") == 0).groupBy("file").agg(F.min_by("value", "at").alias("value"), F.min("at").alias("at"))
    header = headers.orderBy("file").first()
    if header is None:
        return spark.createDataFrame([], "value string")
    names = re.split(sep_regex, header["value"])
    body = lines.join(headers.select("at"), "at", "left_anti")
    parts = F.split("value", sep_regex)
    return _typed(_null_tokens(body.select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])))


def _xlsx_first_sheet(data: bytes) -> pd.DataFrame:
    """Minimal .xlsx reader (first sheet, shared strings, inline strings, numbers)."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", ns):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")))
        sheets = sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml", n))
        root = ElementTree.fromstring(z.read(sheets[0]))
    rows = []
    for row in root.iter(f"{{{ns['m']}}}row"):
        vals = {}
        for c in row.findall("m:c", ns):
            ref = c.get("r", "")
            col = 0
            for ch in re.match(r"[A-Z]+", ref).group(0):
                col = col * 26 + (ord(ch) - 64)
            t = c.get("t")
            v = c.find("m:v", ns)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{ns['m']}}}t"))
            elif v is not None:
                val = v.text
            else:
                val = None
            vals[col - 1] = val
        if vals:
            rows.append([vals.get(i) for i in range(max(vals) + 1)])
    if not rows:
        return pd.DataFrame()
    width = max(len(r) for r in rows)
    header = [str(h) if h is not None else f"Unnamed: {i}" for i, h in enumerate(rows[0] + [None] * (width - len(rows[0])))]
    body = [r + [None] * (width - len(r)) for r in rows[1:]]
    pdf = pd.DataFrame(body, columns=header)
    for c in pdf.columns:
        conv = pd.to_numeric(pdf[c], errors="coerce")
        if conv.notna().sum() == pdf[c].notna().sum():
            pdf[c] = conv
    return pdf


def read_excel(spark: SparkSession, path_glob: str) -> DataFrame:
    """First sheet of every workbook; one file per task; values as strings plus the
    source path (types are left to ``try_cast`` downstream, files may disagree)."""
    files = spark.read.format("binaryFile").load(path_glob)
    first = files.select("path", "content").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "path string")
    cols = list(_xlsx_first_sheet(bytes(first[0]["content"])).columns)
    schema = T.StructType([T.StructField("path", T.StringType())] + [T.StructField(c, T.StringType()) for c in cols])

    def decode(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                sheet = _xlsx_first_sheet(bytes(content)).reindex(columns=cols)
                out = sheet.astype(object).where(sheet.notna(), None).map(lambda v: None if v is None else str(v))
                out.insert(0, "path", p)
                yield out

    return files.select("path", "content").mapInPandas(decode, schema)


def read_sas(spark: SparkSession, path_glob: str) -> DataFrame:
    """sas7bdat via pandas' reader inside tasks; encodings big5, utf-8, raw."""
    files = spark.read.format("binaryFile").load(path_glob)
    first = files.select("content").limit(1).collect()
    if not first:
        raise ValueError("no SAS files")

    def load(content: bytes) -> pd.DataFrame:
        for enc in ("big5", "utf-8", None):
            try:
                return pd.read_sas(io.BytesIO(content), format="sas7bdat", encoding=enc)
            except Exception:  # noqa: BLE001
                continue
        raise ValueError("cannot read SAS file; check its encoding")

    sample = load(bytes(first[0]["content"]))
    schema = T.StructType([T.StructField(c, T.DoubleType() if pd.api.types.is_numeric_dtype(sample[c]) else T.StringType())
                           for c in sample.columns])

    def decode(batches):
        for pdf in batches:
            for content in pdf["content"]:
                yield load(bytes(content))

    return files.mapInPandas(decode, schema)


def read_table(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """Dispatch on the file extension."""
    ext = os.path.splitext(path)[1].lower()
    if ext == ".csv":
        return read_csv(spark, path, delimiter, encoding)
    if ext == ".txt":
        return read_txt(spark, path, delimiter or r"\s+", encoding or "utf-8") if not delimiter or delimiter == r"\s+" \
            else read_csv(spark, path, delimiter, encoding)
    if ext in (".xlsx", ".xls"):
        if ext == ".xls":
            raise ValueError("legacy .xls workbooks are not supported; save as .xlsx")
        return read_excel(spark, path)
    if ext == ".sas7bdat":
        return read_sas(spark, path)
    raise ValueError(f"unsupported file format: {ext}")


def upload_preview(df: DataFrame, order_cols, n: int = 10):
    """(first n rows ordered by ``order_cols`` as strings with nulls -> '', row count,
    [(field, type)])."""
    head = df.orderBy(*order_cols).limit(n)
    rows = head.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    return rows, df.count(), [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def read_documents(spark: SparkSession, path_glob: str) -> DataFrame:
    """Text documents (txt/md/csv) as (path, text): UTF-8, else Big5 ignoring errors."""
    files = spark.read.format("binaryFile").load(path_glob)

    def decode(batches):
        for pdf in batches:
            texts = []
            for b in pdf["content"]:
                b = bytes(b)
                try:
                    texts.append(b.decode("utf-8"))
                except UnicodeDecodeError:
                    texts.append(b.decode("big5", errors="ignore"))
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return files.select("path", "content").mapInPandas(decode, "path string, text string")
