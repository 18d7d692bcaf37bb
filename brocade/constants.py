"""Fixed values of the evaluation protocol."""

SETTINGS = ("text_only", "mask_annotation", "box_annotation", "point_annotation")
AXES = ("edit", "preservation", "quality")
EDIT_TYPES = ("add", "remove", "replace", "mixed", "counting")
STATUSES = ("ok", "missing_output", "annotation_conflict", "judge_parse_error", "judge_runtime_error", "pending")
#: Names of the systems under test where a caller gives none; their order is the order of reports.
METHODS = ("alpha", "beta", "gamma", "delta", "epsilon")
#: Images of each setting, in order.
ROLES = {"text_only": ("source",), "mask_annotation": ("source", "mask"), "box_annotation": ("source", "box"), "point_annotation": ("source", "point")}
BOOTSTRAP_SEED, BOOTSTRAP_DRAWS, BOOTSTRAP_QUANTILES = 20260920, 2000, (0.025, 0.975)
TARGET_AREA, SIDE_STEP = 1024 * 1024, 32
#: Colours of regions in their order, red, green and blue; opacity of a locator's fill out of 255; colours around a contour and a dot.
REGION_COLORS = ((235, 50, 45), (45, 180, 70), (45, 105, 230))
FILL_OPACITY, HALO, RING = 70, (0, 0, 0), (255, 255, 255)
