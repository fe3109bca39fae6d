"""A small catalog manifest for the tests: an observatory, from camera frames to a monthly report."""


def column(description="", tests=(), data_type=None):
    entry = {"description": description, "tests": list(tests)}
    return entry | ({"data_type": data_type} if data_type else {})


def model(name, schema, materialized, description="", columns=None, depends_on=(), **more):
    return {
        "name": name,
        "alias": name,
        "resource_type": "model",
        "description": description,
        "original_file_path": f"sky/{schema}/{name}.sql",
        "database": "observatory",
        "schema": schema,
        "config": {"materialized": materialized},
        "raw_code": f"-- {name}\nselect 1",
        "columns": columns or {},
        "depends_on": {"nodes": list(depends_on)},
        "tags": [],
    } | more


def sample():
    """Seven models with a diamond, a versioned id, a seed, a test, two sources and an exposure."""
    frames = {
        "frame_id": column("Number of the frame", ["unique"]),
        "night": column("Night it was taken"),
        "filter_band": column(),
    }
    targets = {"target_id": column("", ["not_null"]), "ra": column(), "dec": column()}
    brightness = {
        "target_id": column(),
        "night": column(),
        "magnitude": column("Apparent magnitude", [{"in_range": {"low": -2}}]),
    }
    nights = {"night": column("Date", ["unique", "not_null"]), "moon": column("Phase")}
    nodes = {
        "seed.sky.bands": {"name": "bands", "resource_type": "seed"},
        "model.sky.stg_frames": model(
            "stg_frames", "landing", "incremental", "One row per frame.", frames, ["source.sky.camera"]
        ),
        "model.sky.stg_targets": model(
            "stg_targets", "landing", "view", "", targets, ["source.sky.catalogue", "seed.sky.bands"]
        ),
        "model.sky.int_matches": model(
            "int_matches", "work", "ephemeral", "Frames with their targets.", {},
            ["model.sky.stg_frames", "model.sky.stg_targets"],
        ),
        "model.sky.fct_brightness": model(
            "fct_brightness", "serving", "table", "", brightness,
            ["model.sky.int_matches", "model.sky.stg_targets"],
        ),
        "model.sky.dim_nights": model(
            "dim_nights", "serving", "table", "Nights.", nights, ["model.sky.stg_frames"]
        ),
        "model.sky.rpt_monthly.v2": model(
            "rpt_monthly", "serving", "table", "", {"total": column()},
            ["model.sky.dim_nights", "model.sky.fct_brightness"],
        ),
        "model.sky.Scratch-Pad": model("Scratch-Pad", "work", "view"),
        "test.sky.unique_frame": {"name": "unique_frame", "resource_type": "test"},
    }
    return {
        "metadata": {"version": "12"},
        "nodes": nodes,
        "sources": {
            "source.sky.camera": {"name": "camera", "source_name": "raw", "identifier": "camera_log"},
            "source.sky.catalogue": {"name": "catalogue", "source_name": "raw", "loaded_at_field": "seen"},
        },
        "exposures": {
            "exposure.sky.board": {
                "name": "board", "type": "dashboard", "depends_on": {"nodes": ["model.sky.rpt_monthly.v2"]}
            }
        },
    }
