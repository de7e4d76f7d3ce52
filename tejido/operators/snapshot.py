"""Several tables that change together: written apart, seen at once.

A restore stages each table in a folder of its attempt, then publishes one manifest that names the folders, the row counts and
the last number of each identity column. Readers go by the newest manifest, so they see all tables of a restore or none: a failure in
any table leaves what was there, and its attempt is taken away. The manifest is made under another name and renamed, and a
rename onto a name that is taken fails, so of two restores at once one is refused.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Occupied(ValueError):
    """There are rows that a restore would write over."""


@dataclass(frozen=True)
class Tables:
    """The tables of a folder."""

    spark: SparkSession
    folder: str

    def _at(self, *names: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        path, fs = self._at("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{"tables": {name: {"path", "rows", "last"}}} of a version, the newest unless it is said."""
        found = self.versions()
        if not found:
            return {"tables": {}}
        path = f"{self.folder}/manifests/{found[-1] if version is None else version:08}.json"
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.manifest()["tables"][name]["path"])

    def last_number(self, name: str) -> int:
        """The last number that the table's identity column has given out."""
        return self.manifest()["tables"].get(name, {}).get("last") or 0

    def numbered(self, rows: DataFrame, name: str, column: str = "id") -> DataFrame:
        """New rows with numbers of their own, beyond all that were given out; there may be gaps."""
        return rows.withColumn(column, F.monotonically_increasing_id() + (self.last_number(name) + 1))

    def restore(self, tables: dict[str, DataFrame], identity: dict[str, str] | None = None, force: bool = False) -> int:
        """Puts tables in the place of what is there; returns the version. identity: the identity column of a table.

        What holds rows isn't written over unless forced. Tables that aren't named stay as they are.
        """
        before = self.manifest()["tables"]
        held = {k: v["rows"] for k, v in before.items() if k in tables and v["rows"]}
        if held and not force:
            raise Occupied(f"there are rows already: {held}")
        attempt = f"attempts/{uuid.uuid4().hex}"
        try:
            after = dict(before)
            for name, df in tables.items():
                path = f"{self.folder}/{attempt}/{name}"
                df.write.mode("errorifexists").parquet(path)
                number = (identity or {}).get(name)
                facts = self.spark.read.schema(df.schema).parquet(path).agg(F.count("*"), F.max(number) if number else F.lit(None)).first()
                after[name] = {"path": path, "rows": facts[0], "last": max([x for x in (facts[1], before.get(name, {}).get("last")) if x is not None], default=None)}
            return self._publish({"tables": after})
        except BaseException:
            path, fs = self._at(attempt)
            fs.delete(path, True)
            raise

    def _publish(self, manifest: dict) -> int:
        version = max(self.versions(), default=0) + 1
        staged, fs = self._at("staged", f"{uuid.uuid4().hex}.json")
        out = fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            out.close()
        final, _ = self._at("manifests", f"{version:08}.json")
        fs.mkdirs(final.getParent())
        if fs.exists(final) or not fs.rename(staged, final):
            raise Occupied(f"version {version} was published by another")
        return version

    def reset(self, confirmed: bool = False) -> int:
        """All tables gone from sight, numbers from one again; what they held stays until vacuum."""
        if not confirmed:
            raise Occupied("a reset leaves no table; it has to be confirmed")
        return self._publish({"tables": {}})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Takes away attempts that none of the last `keep` versions names; not while a restore is under way."""
        named = {v["path"].removeprefix(f"{self.folder}/").split("/")[1] for n in self.versions()[-keep:] for v in self.manifest(n)["tables"].values()}
        path, fs = self._at("attempts")
        gone = [f.getPath() for f in (fs.listStatus(path) if fs.exists(path) else []) if f.getPath().getName() not in named]
        for p in gone:
            fs.delete(p, True)
        return [p.getName() for p in gone]
