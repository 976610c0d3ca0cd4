"""Declared schemas of the catalogue tables, in Spark's schema language; nothing is inferred."""

from __future__ import annotations

LIST_ATTRIBUTES = ("images", "main_camera", "screen", "memory", "battery", "connectivity", "security")
SCALARS = ("secondary_camera", "oficial_web", "red", "processor", "gpu", "expansion", "os", "dimensions", "video_youtube")


TABLES = {
    "brand": "id_brand bigint NOT NULL, brand_name string",
    "model": "id_model bigint NOT NULL, model_name string, id_brand bigint NOT NULL",
    "phone": "id_phone bigint NOT NULL, " + ", ".join(f"{c} string" for c in SCALARS) + ", id_model bigint NOT NULL",
    "phone_list": "id_phone bigint, attr string, pos int, value string",
    "color": "id_color bigint NOT NULL, name string NOT NULL",
    "box_content": "id_content bigint NOT NULL, name_content string NOT NULL",
    "phone_colors": "id_phone bigint, id_color bigint, pos int",
    "phone_box_contents": "id_phone bigint, id_content bigint, pos int",
}
#: A phone submission as it is sent, plus our order number and what could not be read.
SUBMISSION = (
    "seq bigint, idPhone bigint, images array<string>, mainCamera array<string>, secondaryCamera string, red string, oficialWeb string, "
    "screen array<string>, processor string, gpu string, memory array<string>, expansion string, os string, battery array<string>, "
    "connectivity array<string>, dimensions string, security array<string>, colors array<bigint>, boxContents array<bigint>, "
    "videoYoutube string, idModel bigint, _corrupt string"
)
#: The submission's field for each column of ours.
SUBMISSION_NAMES = {
    "id_phone": "idPhone", "images": "images", "main_camera": "mainCamera", "secondary_camera": "secondaryCamera", "red": "red",
    "oficial_web": "oficialWeb", "screen": "screen", "processor": "processor", "gpu": "gpu", "memory": "memory", "expansion": "expansion",
    "os": "os", "battery": "battery", "connectivity": "connectivity", "dimensions": "dimensions", "security": "security",
    "video_youtube": "videoYoutube", "id_model": "idModel",
}
