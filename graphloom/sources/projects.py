"""What a folder of files holds: languages, build manifests, service descriptors, version catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by file extension, and build manifests by file name.
EXTENSIONS = {"java": "java", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "vue": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "cs": "csharp", "html": "web", "htm": "web", "css": "web"}
MANIFESTS = {"pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java", "tsconfig.json": "typescript", "deno.json": "typescript", "package.json": "javascript", "pyproject.toml": "python", "setup.py": "python", "setup.cfg": "python", "requirements.txt": "python"}


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path of the files below a folder; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path")


def languages(files: DataFrame) -> DataFrame:
    """lang, files, manifests, main of files (path): by extension and manifest; main: most files, of those with a manifest first."""
    name = F.lower(F.substring_index("path", "/", -1))
    of = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    lang = F.when(name.contains("."), of(EXTENSIONS, F.substring_index(name, ".", -1)))
    manifest = F.coalesce(of(MANIFESTS, name), F.when(name.endswith(".csproj") | name.endswith(".sln"), "csharp"))
    each = files.select(lang.alias("lang"), F.lit(0).alias("m")).union(files.select(manifest, F.lit(1))).filter("lang IS NOT NULL")
    counted = each.groupBy("lang").agg(F.count_if(F.col("m") == 0).alias("files"), F.sum("m").alias("manifests"))
    best = counted.agg(F.max_by("lang", F.struct(F.col("manifests") > 0, "files", "lang")).alias("best"))  # one row
    return counted.join(F.broadcast(best)).select("lang", "files", "manifests", (F.col("lang") == F.col("best")).alias("main"))


def services(files: DataFrame) -> DataFrame:
    """service, provider, source, line of service descriptors (path, value): the file is named by the service, each line by a provider."""
    service = F.regexp_extract("path", r"META-INF/services/([^/]+)$", 1)
    lines = files.select(F.col("path").alias("source"), service.alias("service"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).filter("service <> ''")
    provider = F.trim(F.substring_index("text", "#", 1))
    return lines.select("service", provider.alias("provider"), "source", (F.col("line") + 1).alias("line")).filter("provider <> ''").distinct()


def version_catalog(files: DataFrame) -> DataFrame:
    """source, kind, alias, coordinate, version of version catalogs (path, value), versions by reference looked up. Files that can't be read have kind "skipped"."""
    import pyarrow as pa

    def entries(text: str):
        import tomllib

        try:
            found = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError as e:
            return [("skipped", "", str(e), None)]
        versions = found.get("versions", {})

        def version(v):
            if isinstance(v, dict):
                v = versions.get(v["ref"]) if "ref" in v else v.get("strictly") or v.get("require") or v.get("prefer")
            return version(v) if isinstance(v, dict) else v

        out = []
        for kind in ("libraries", "plugins"):
            for alias, v in found.get(kind, {}).items():
                if isinstance(v, str):
                    name, _, own = v.rpartition(":")
                else:
                    name, own = v.get("module") or v.get("id") or f"{v.get('group', '')}:{v.get('name', '')}", version(v.get("version"))
                out.append((kind, alias.replace("-", ".").replace("_", "."), name, own))
        return out + [("versions", a, a, version(v)) for a, v in versions.items()] + [("bundles", a, ",".join(v), None) for a, v in found.get("bundles", {}).items()]

    def run(batches):
        for batch in batches:
            rows = [(p, *e) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in entries(t)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["source", "kind", "alias", "coordinate", "version"])

    return files.select("path", "value").mapInArrow(run, "source string, kind string, alias string, coordinate string, version string")
