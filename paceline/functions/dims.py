"""Fixed dimensions of the standard course and of the body model (all far below any broadcast bound)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WALL_W, WALL_H = 3.0, 15.0
ROUTE_IMAGE_W, ROUTE_IMAGE_H = 376, 531

# Hold centres in pixels of the route diagram (hold number, x, y downward).
HOLD_PIXELS = [
    (1, 222.239, 467.533), (2, 227.011, 458.337), (3, 199.196, 429.141), (4, 171.398, 396.925), (5, 190.043, 368.587),
    (6, 204.215, 348.581), (7, 189.374, 320.593), (8, 208.309, 286.915), (9, 218.308, 258.725), (10, 175.356, 235.967),
    (11, 184.792, 211.406), (12, 166.359, 202.587), (13, 189.979, 168.552), (14, 170.708, 146.010), (15, 185.227, 127.082),
    (16, 180.204, 116.452), (17, 152.021, 92.809), (18, 199.196, 64.239), (19, 217.622, 41.078), (20, 189.495, 26.484),
]

# Attachment bolts (hold, panel side, panel number, column letter, row) and the column letters.
BOLT_COLUMNS = "ABCDEFGHILM"
BOLTS = [
    (1, "DX", 2, "F", 1), (2, "DX", 2, "G", 3), (3, "DX", 2, "A", 9), (4, "SN", 3, "G", 4), (5, "SN", 3, "M", 10),
    (6, "DX", 4, "B", 2), (7, "SN", 4, "M", 8), (8, "DX", 5, "C", 3), (9, "DX", 5, "E", 9), (10, "SN", 6, "H", 2),
    (11, "SN", 6, "L", 7), (12, "SN", 6, "F", 9), (13, "SN", 7, "M", 4), (14, "SN", 7, "G", 9), (15, "SN", 8, "L", 1),
    (16, "SN", 8, "I", 3), (17, "SN", 8, "C", 8), (18, "DX", 9, "A", 2), (19, "DX", 9, "E", 7), (20, "SN", 9, "M", 10),
]

# Body segments (name, near joint, far joint, mass share, centre ratio, required), published adult male model.
SEGMENTS = [
    ("head", "head", "neck", 0.0694, 0.5002, False), ("trunk", "neck", "midHip", 0.4346, 0.4486, True),
    ("leftUpperArm", "leftShoulder", "leftElbow", 0.0271, 0.5772, False), ("rightUpperArm", "rightShoulder", "rightElbow", 0.0271, 0.5772, False),
    ("leftForearm", "leftElbow", "leftWrist", 0.0223, 0.6751, False), ("rightForearm", "rightElbow", "rightWrist", 0.0223, 0.6751, False),
    ("leftThigh", "leftHip", "leftKnee", 0.1416, 0.4095, False), ("rightThigh", "rightHip", "rightKnee", 0.1416, 0.4095, False),
    ("leftShank", "leftKnee", "leftAnkle", 0.0433, 0.4459, False), ("rightShank", "rightKnee", "rightAnkle", 0.0433, 0.4459, False),
    ("leftFoot", "leftHeel", "leftToe", 0.0137, 0.4415, False), ("rightFoot", "rightHeel", "rightToe", 0.0137, 0.4415, False),
]

# Landmark number of each named joint.
JOINTS = {
    "head": 0, "leftShoulder": 11, "rightShoulder": 12, "leftElbow": 13, "rightElbow": 14, "leftWrist": 15, "rightWrist": 16,
    "leftHip": 23, "rightHip": 24, "leftKnee": 25, "rightKnee": 26, "leftAnkle": 27, "rightAnkle": 28, "leftHeel": 29,
    "rightHeel": 30, "leftToe": 31, "rightToe": 32,
}

# Media variations (id, seconds trimmed from the front, silent).
VARIATIONS = [
    ("control-720", 0.0, False), ("compact-360", 0.0, False), ("dark-720", 0.0, False),
    ("low-fps-720", 0.0, False), ("silent-720", 0.0, True), ("trim-2s-720", 2.0, False),
]


def holds(spark: SparkSession) -> DataFrame:
    """DIM1: the 20 holds with wall metres from the diagram."""
    d = spark.createDataFrame(HOLD_PIXELS, "hold_id int, px double, py double")
    return d.select("hold_id", (F.col("px") / ROUTE_IMAGE_W * WALL_W).alias("hold_x"), ((1 - F.col("py") / ROUTE_IMAGE_H) * WALL_H).alias("hold_y"))


def bolts(spark: SparkSession) -> DataFrame:
    """DIM2: the 20 attachment bolts, metres above the panel grid."""
    d = spark.createDataFrame(BOLTS, "hold_id int, side string, panel int, col string, row int")
    letter = F.expr(f"instr('{BOLT_COLUMNS}', col)")
    return d.select("hold_id", F.concat("side", F.col("panel").cast("string")).alias("panel"), F.concat("col", F.col("row").cast("string")).alias("grid"),
                    (F.when(F.col("side") == "DX", 1.5).otherwise(0.0) + 0.125 + (letter - 1) * 0.125).alias("bolt_x"),
                    ((F.col("panel") - 1) * 1.5 + 0.1875 + (F.col("row") - 1) * 0.125).alias("bolt_y"))


def segments(spark: SparkSession) -> DataFrame:
    """DIM3: the body segments."""
    return spark.createDataFrame(SEGMENTS, "segment string, proximal string, distal string, mass double, ratio double, required boolean")


def joints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(JOINTS.items()), "joint string, landmark_idx int")


def variations(spark: SparkSession) -> DataFrame:
    """DIM4: the controlled media variations."""
    return spark.createDataFrame(VARIATIONS, "variation_id string, trim_s double, silent boolean")
