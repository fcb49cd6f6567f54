"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where the session names none (local tests), one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


#: Hadoop's local file system, checksums and permissions included, but for permissions it doesn't start a process.
_PLAIN = """
package gridloom;

import java.io.IOException;
import java.nio.file.Files;
import java.nio.file.attribute.PosixFilePermissions;
import org.apache.hadoop.fs.LocalFileSystem;
import org.apache.hadoop.fs.Path;
import org.apache.hadoop.fs.RawLocalFileSystem;
import org.apache.hadoop.fs.permission.FsPermission;

public class PlainLocalFileSystem extends LocalFileSystem {
    public PlainLocalFileSystem() { super(new Raw()); }

    public static class Raw extends RawLocalFileSystem {
        public void setPermission(Path path, FsPermission p) throws IOException {
            if (p.getStickyBit()) {
                super.setPermission(path, p);
            } else {
                String text = p.getUserAction().SYMBOL + p.getGroupAction().SYMBOL + p.getOtherAction().SYMBOL;
                Files.setPosixFilePermissions(pathToFile(path).toPath(), PosixFilePermissions.fromString(text));
            }
        }
    }
}
"""
_plain: dict[str, dict[str, str]] = {}


def _writing(spark: SparkSession, path: str) -> dict[str, str]:
    """Options for writing below path.

    Without its native library Hadoop starts ``chmod`` several times for each local
    file. Until such a child has begun its own program it shares the executor's whole
    memory, which counts twice meanwhile. So local folders are written through a file
    system of our own; others, and those where it can't be made, as ever.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    if jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).getUri().getScheme() != "file" or conf.get("fs.file.impl"):
        return {}
    app = spark.sparkContext.applicationId
    if app not in _plain:
        _plain[app] = {}
        try:
            if not jvm.org.apache.hadoop.io.nativeio.NativeIO.isAvailable() and not jvm.org.apache.hadoop.util.Shell.WINDOWS:
                compiler = jvm.org.codehaus.janino.SimpleCompiler()
                compiler.setParentClassLoader(conf.getClassLoader())
                compiler.cook(_PLAIN)
                jar = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom_files.jar"
                with zipfile.ZipFile(jar, "w") as z:
                    for name, code in compiler.getBytecodes().items():
                        z.writestr(name.replace(".", "/") + ".class", bytes(code))
                urls = spark.sparkContext._gateway.new_array(jvm.java.net.URL, 1)
                urls[0] = jvm.java.io.File(str(jar)).toURI().toURL()
                loader = jvm.java.net.URLClassLoader(urls, conf.getClassLoader())
                loader.loadClass("gridloom.PlainLocalFileSystem")
                conf.setClassLoader(loader)
                spark._jsc.addJar(str(jar))
                _plain[app] = {"fs.file.impl": "gridloom.PlainLocalFileSystem", "fs.file.impl.disable.cache": "true"}
        except (Py4JError, TypeError):  # TypeError: no such class here
            pass
    return _plain[app]


_written: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there and survives lost executors.

    Spark removes the write's shuffle files as soon as it has ended, as nothing reads
    them again; else they would stay until its driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**_writing(spark, path)).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table from materialise() that nothing reads any more."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables of materialise() in this process; results that were built on them can't be read any more."""
    while _written:
        where = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, for clusters whose workers don't see the repository."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom_pkg.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in (root / "gridloom").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
