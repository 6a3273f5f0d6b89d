"""Models kept as tables, of which one version is active, and scoring that loads it.

A version is a folder of rows: nodes of the trees, centres and scales, percentiles of the scores; its last table is the manifest, without which it doesn't exist.
Which version is active is the last of a row of markers, each a folder of its own that counts once Spark has written it, so a switch is one
write that is there or isn't, and a switch back is one more marker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.operators.anomaly import Model

NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"
CENTRES, STEPS, MANIFEST = "feature string, centre double, scale double", "score string, place int, value double", "version int, psi int, trained_on long, nodes long"


class ModelStore:
    """Models of one name under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str, mark: str) -> list[str]:
        found = [x.getPath().getName() for x in self._fs.listStatus(self._at(folder))] if self._fs.exists(self._at(folder)) else []
        return sorted(n for n in found if self._fs.exists(self._at(f"{folder}/{n}/{mark}")))

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("versions", "manifest/_SUCCESS")]

    def active(self) -> int | None:
        marks = self._names("active", "_SUCCESS")
        return int(marks[-1].split("-")[1]) if marks else None

    def save(self, model: Model) -> int:
        """Keep ``model`` as the next version; nothing is switched yet."""
        version = max(self.versions(), default=0) + 1
        folder = f"{self.path}/versions/{version:06d}"
        nodes = [(t, i, *node) for t, tree in enumerate(model.forest) for i, node in enumerate(tree)]
        centres = [(f, float(c), float(s)) for f, (c, s) in model.centres.items()]
        steps = [(s, i, float(v)) for s, values in model.thousandths.items() for i, v in enumerate(values)]
        for name, rows, schema in (("nodes", nodes, NODES), ("centres", centres, CENTRES), ("steps", steps, STEPS), ("manifest", [(version, model.psi, model.trained_on, len(nodes))], MANIFEST)):
            self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")
        return version

    def activate(self, version: int) -> None:
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        n = len(self._names("active", "_SUCCESS"))
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/active/{n:08d}-{version}")

    def load(self, version: int | None = None) -> Model | None:
        """The model of ``version``, or the active one; its tables are of bounded size."""
        version = self.active() if version is None else version
        if version is None:
            return None
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.path}/versions/{version:06d}/{name}")
        forest: dict[int, list[tuple]] = {}
        for r in read("nodes", NODES).orderBy("tree", "node").collect():
            forest.setdefault(r.tree, []).append((r.feature, r.cut, r.left, r.right, r.depth))
        steps: dict[str, list[float]] = {}
        for r in read("steps", STEPS).orderBy("score", "place").collect():
            steps.setdefault(r.score, []).append(r.value)
        about = read("manifest", MANIFEST).first()
        return Model({r.feature: (r.centre, r.scale) for r in read("centres", CENTRES).collect()}, [forest[t] for t in sorted(forest)], about.psi, steps, about.trained_on)

    def manifest(self) -> DataFrame:
        """(version, psi, trained_on, nodes, is_active) of every version."""
        rows = self.spark.read.schema(MANIFEST).parquet(*[f"{self.path}/versions/{v:06d}/manifest" for v in self.versions()]) if self.versions() else self.spark.createDataFrame([], MANIFEST)
        return rows.withColumn("is_active", F.coalesce(F.col("version") == F.lit(self.active()), F.lit(False)))
