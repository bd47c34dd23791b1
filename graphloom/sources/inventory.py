"""File inventories: scanning, classification, technologies and document loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import ship

#: Languages by extension.
LANGUAGES = {
    "c": "C", "cc": "C++", "cpp": "C++", "cs": "C#", "css": "CSS", "go": "Go", "groovy": "Groovy", "h": "C/C++ Header", "hpp": "C++ Header", "html": "HTML", "java": "Java", "js": "JavaScript",
    "jsx": "JavaScript", "kt": "Kotlin", "kts": "Kotlin", "php": "PHP", "pl": "Perl", "py": "Python", "rb": "Ruby", "rs": "Rust", "scala": "Scala", "sh": "Shell", "sql": "SQL", "ts": "TypeScript",
    "tsx": "TypeScript", "vue": "Vue",
}
#: Kinds by extension, names of build files, and folders of generated and test code.
CONFIG = ("conf", "config", "ini", "json", "properties", "toml", "xml", "yaml", "yml")
ARCHIVE = ("7z", "ear", "gz", "jar", "rar", "tar", "war", "zip")
BINARY = ("class", "dll", "dylib", "exe", "o", "obj", "pdb", "pyc", "so")
DOCUMENTATION = ("adoc", "md", "rst", "txt")
ASSETS = ("bmp", "gif", "ico", "jpeg", "jpg", "mp3", "mp4", "pdf", "png", "svg", "webp", "woff", "woff2")
BUILD_FILES = ("build.gradle", "build.gradle.kts", "dockerfile", "gradle.properties", "makefile", "package-lock.json", "package.json", "pom.xml", "pyproject.toml", "requirements.txt", "settings.gradle", "settings.gradle.kts")
GENERATED_FOLDERS = ("generated", "generated-sources", "generated-test-sources", "target", "build", "dist", "out")
TEST_FOLDERS = ("test", "tests", "testing", "testfixture", "testfixtures", "integration-test", "integration-tests", "integrationtest", "integrationtests", "it", "tck", "spec", "specs")
TEST_TREES = (*TEST_FOLDERS, "__tests__", "example", "examples", "sample", "samples", "fixture", "fixtures")
#: Technologies by the manifest that tells of them.
TECHNOLOGIES = {"pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "package.json": "npm", "pyproject.toml": "python", "requirements.txt": "python", "Cargo.toml": "cargo", "Dockerfile": "docker", "go.mod": "go"}
IGNORED_FOLDERS = (".git", ".svn", ".hg", ".idea", ".venv", "__pycache__", "node_modules")


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, size, modified, sha256, content)`` of the files under ``root``, ignored folders left out; content is bytes."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    ignored = r"/(?:" + "|".join(x.replace(".", r"\.") for x in IGNORED_FOLDERS) + ")/"
    return files.where(~F.col("path").rlike(ignored)).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")


def load_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` of Markdown and text files as UTF-8 texts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    return files.where(extension.isin(*DOCUMENTATION)).select("path", F.decode("content", "UTF-8").alias("content"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The last suffix in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """The language by extension, or null."""
    suffix = extension(path)
    found = F.lit(None).cast("string")
    for name, value in LANGUAGES.items():
        found = F.when(suffix == name, value).otherwise(found)
    return found


def is_test_path(path: Column) -> Column:
    """Whether the folder after the first ``src`` is one of tests, or, without ``src`` or before it, any folder is."""
    folders = F.transform(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x: F.lower(x))
    at = F.array_position(folders, "src")
    after = F.coalesce(F.try_element_at(folders, F.when(at > 0, at + 1).cast("int")), F.lit(""))
    before = F.when(at > 0, F.slice(folders, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0)))).otherwise(folders)
    trees = F.array(*(F.lit(x) for x in TEST_TREES))
    return F.when((at > 0) & after.isin(*TEST_FOLDERS), True).otherwise(F.arrays_overlap(before, trees))


def kind(path: Column) -> Column:
    """generated (by any folder), build (by name), source (any known language), then by extension config, archive, binary,
    documentation or asset; else unknown. The first that fits; whether a file is a test is told by ``is_test_path``."""
    suffix, name = extension(path), F.lower(file_name(path))
    folders = F.transform(F.split(path, "/"), lambda x: F.lower(x))
    above = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
    found = F.lit("unknown")
    for value, suffixes in (("asset", ASSETS), ("documentation", DOCUMENTATION), ("binary", BINARY), ("archive", ARCHIVE), ("config", CONFIG)):
        found = F.when(suffix.isin(*suffixes), value).otherwise(found)
    found = F.when(name.isin(*BUILD_FILES), "build").when(language(path).isNotNull(), "source").otherwise(found)
    return F.when(F.arrays_overlap(above, F.array(*(F.lit(x) for x in GENERATED_FOLDERS))), "generated").otherwise(found)


def classified(files: DataFrame) -> DataFrame:
    """``files`` with ``language`` and ``kind``."""
    return files.withColumn("language", language(F.col("path"))).withColumn("kind", kind(F.col("path")))


def technologies(files: DataFrame) -> DataFrame:
    """``(project, technology, evidence)``: what a project's manifests tell of, with the number of them."""
    name = file_name(F.col("path"))
    found = F.lit(None).cast("string")
    for manifest, technology in TECHNOLOGIES.items():
        found = F.when(name == manifest, technology).otherwise(found)
    return files.withColumn("technology", found).where(F.col("technology").isNotNull()).groupBy("project", "technology").agg(F.count("*").alias("evidence"))


def project_fingerprints(files: DataFrame) -> DataFrame:
    """``(project, files, fingerprint)``: a digest of each project's paths and contents that does not depend on their order.

    It sums the rows' digests, so a project of any size is aggregated before the shuffle; times play no part.
    """
    own = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "path", "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return files.groupBy("project").agg(F.count("*").alias("files"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), F.sum(own).cast("string")), 256).alias("fingerprint"))


def discovered_projects(files: DataFrame) -> DataFrame:
    """``(root, markers, parent)``: folders with a manifest, its technologies in order, and the nearest such folder above, or null."""
    from graphloom.operators.lookups import ancestors

    name = file_name(F.col("path"))
    found = F.lit(None).cast("string")
    for manifest, technology in TECHNOLOGIES.items():
        found = F.when(name == manifest, technology).otherwise(found)
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(".")
    roots = files.withColumn("t", found).where(F.col("t").isNotNull()).groupBy(folder.alias("root")).agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("markers"))
    above = roots.where("root <> '.'").select("root", F.posexplode(ancestors(F.col("root"))).alias("depth", "up")).join(roots.select(F.col("root").alias("up")), "up")
    nearest = above.groupBy("root").agg(F.max_by("up", "depth").alias("parent"))
    return roots.join(nearest, "root", "left")
