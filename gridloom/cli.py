"""List variables of files, or join fields of many files into as few as possible and write them as Parquet.

    python -m gridloom.cli list FILE...
    python -m gridloom.cli join --variable V --out DIR FILE...
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridloom.operators.combine import aggregate
from gridloom.sources import netcdf3


def listing(paths: Sequence[str]) -> list[str]:
    out = []
    for p in paths:
        for v in netcdf3.variables(p).values():
            shape = ", ".join(f"{d} {n}" for d, n in zip(v.dims, v.shape))
            out.append(f"{p}: {v.name}({shape}) {v.attributes.get('units', '')}".rstrip())
    return out


def join(spark: SparkSession, paths: Sequence[str], variable: str, out: str) -> int:
    """Join along whichever axis differs; coordinate variables have their axis' name. Returns the number of fields written."""
    fields = []
    for p in paths:
        found = netcdf3.variables(p)
        v = found[variable]
        axes = {}
        for d in v.dims:
            if d in found:
                axes[d] = netcdf3.read(spark, p, d).select(F.col(f"i_{d}").alias("i"), F.col(d).cast("double").alias("coord"))
            else:
                n = v.shape[v.dims.index(d)]
                axes[d] = spark.range(n).select(F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("coord"))
        fields.append({"name": variable, "units": v.attributes.get("units"), "df": netcdf3.read(spark, p, variable), "value": variable, "axes": axes})
    joined = aggregate(fields)
    for k, f in enumerate(joined):
        f["df"].write.mode("overwrite").parquet(f"{out}/{variable}_{k}")
    return len(joined)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="what", required=True)
    ls = sub.add_parser("list")
    ls.add_argument("files", nargs="+")
    jn = sub.add_parser("join")
    jn.add_argument("--variable", required=True)
    jn.add_argument("--out", required=True)
    jn.add_argument("files", nargs="+")
    args = parser.parse_args(argv)
    if args.what == "list":
        print("\n".join(listing(args.files)))
        return
    spark = SparkSession.builder.getOrCreate()
    print(f"{join(spark, args.files, args.variable, args.out)} fields written to {args.out}")


if __name__ == "__main__":
    main()
