"""Helpers shared by the operators: table reads, the shared folder, written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkeda.session import ensure_shipped

#: A word of every contract here: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, whole; also makes the package importable on the executors."""
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Where the setting is missing, a local session gets a scratch folder of its own;
    on a cluster a missing setting is an error, since no local folder is shared."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sparkeda-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once into a table in the shared folder, and read from there.

    Cuts the lineage so that a lost executor never costs more than re-reading the table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Lets a finished query's shuffle files go; without it they stay until the driver's garbage collection.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """``written`` for a table that ``dropped`` takes away again; the shuffle files of its making go at once."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        path = new_path(spark, name)
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of ``scratch`` tables that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def uniform(*cols, seed: int):
    """A number in [0, 1) fixed by the columns and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def n_words(text):
    """Words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spaced(text: str) -> str | None:
    """A text that has one space or line feed between words and no other white space, with a space between all its words.

    A word after a line feed, and the first one, begins with a line feed; other texts give None."""
    if (not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text):
        return None
    if not text.replace("\n", "").isprintable():  # white space other than a space isn't printable; look closer
        n = len(words := text.split())
        if len(text) - sum(map(len, words)) != n - 1 or text.count(" ") + text.count("\n") != n - 1:
            return None
    return ("\n" + text).replace("\n", " \n")[1:]


def spaced_words(text: str) -> list[str] | None:
    """The words of a ``spaced`` text."""
    line = spaced(text)
    return None if line is None else line.split(" ")


class WordCache:
    """What words turn into, remembered up to ``size`` words; ``learn(words) -> values`` works new ones off."""

    def __init__(self, size: int, learn):
        self.size, self.learn, self.known = size, learn, {}

    def texts(self, cut: list[list[str]]) -> list[bytes]:
        """The values of the words of each text, joined; a word that is known is looked up once."""
        value = self.known.get
        got = [list(map(value, c)) for c in cut]
        out = [_joined(v) for v in got]
        late = [k for k, x in enumerate(out) if x is None]  # texts with words that are not known yet
        if late:
            new = list(dict.fromkeys([w for k in late for w, x in zip(cut[k], got[k]) if x is None]))
            if len(self.known) + len(new) > self.size:
                self.known = {w: x for c, v in zip(cut, got) for w, x in zip(c, v) if x is not None}
            self.known.update(zip(new, self.learn(new)))
            value = self.known.__getitem__
            for k in late:
                out[k] = b"".join(map(value, cut[k]))
        return out

    def each(self, words: list[str]) -> list[bytes]:
        """The value of each of some different words."""
        got = list(map(self.known.get, words))
        new = [w for w, x in zip(words, got) if x is None]
        if new:
            if len(self.known) + len(new) > self.size:
                self.known = {w: x for w, x in zip(words, got) if x is not None}
            values = self.learn(new)
            self.known.update(zip(new, values))
            late = iter(values)
            got = [next(late) if x is None else x for x in got]
        return got


def _joined(values: list) -> bytes | None:
    """None if a value is missing."""
    try:
        return b"".join(values)
    except TypeError:
        return None


def runs(texts: list, most: int):
    """Ranges ``(from, to)`` of texts of about ``most`` characters, so that little is held as lists of words."""
    at = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)
