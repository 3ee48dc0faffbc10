"""SRC-9: dataset catalog and dispatch by source."""

from __future__ import annotations

# The two catalogued case studies.
CATALOG = {
    "synthetic_100d_function": {
        "source": "",
        "description": "generated design with 100 inputs and one response",
        "parameters": {"n_samples": 500, "seed": None},
    },
    "tsunami_tokushima": {
        "source": "zenodo",
        "description": "water level patterns and inundation maps as text matrices",
        "files": ["Initial_water_level_distibutions.zip", "tsunami_water_level_disributions.zip",
                  "Inundation_distibutions.zip"],
    },
}


def load(spark, name: str, data_dir: str | None = None, seed: int = 42):
    """Return the design DataFrame ``(id, x, y)`` of a catalogued dataset.

    Source ``""`` generates the synthetic design (seeded by hash, see SRC-8);
    ``"zenodo"`` reads already-downloaded text matrices from ``data_dir``
    (input levels then the five pattern files, and the output matrix);
    any other source is rejected.
    """
    if name not in CATALOG:
        raise ValueError(f"unknown dataset {name!r}")
    entry = CATALOG[name]
    src = entry["source"]
    if src == "":
        from surrogata.functions.synthetic import generate
        n = entry["parameters"]["n_samples"]
        s = entry["parameters"]["seed"]
        return generate(spark, n, seed if s is None else s)
    if src == "zenodo":
        if data_dir is None:
            raise ValueError("file-based datasets need data_dir with the extracted matrices")
        return load_water_level_case(spark, data_dir)
    raise ValueError(f"unsupported dataset source {src!r}")


# Order of the input matrices (initial level, then the five
# time patterns) and the output file.
INPUT_PATTERNS = ["initial", "0100", "0250", "0500", "1200", "2400"]


def load_water_level_case(spark, data_dir: str, output_file: str = "output.csv"):
    """SRC-1 x 7 -> SRC-2 -> AGG-6 (representative station) -> PRJ-3."""
    from pyspark.sql import functions as F
    from surrogata.operators.stats import representative_position
    from surrogata.sources.matrix import assemble, read_matrix
    xs = [read_matrix(spark, f"{data_dir}/{p}.csv") for p in INPUT_PATTERNS]
    x = assemble(xs)
    y = read_matrix(spark, f"{data_dir}/{output_file}").withColumnRenamed("x", "yv")
    station = representative_position(y, "yv").first()["station"]
    return x.join(y, "id").select("id", "x", F.element_at("yv", station + 1).alias("y"))
