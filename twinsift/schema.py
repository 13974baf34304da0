"""Schemas of the tables the engine works on."""

IMAGE_ROW = (
    "path STRING NOT NULL, width INT, height INT, file_size BIGINT, format STRING, mode STRING, "
    "phash STRING, ahash STRING, dhash STRING, whash STRING"
)
VIDEO_ROW = (
    "path STRING NOT NULL, duration DOUBLE, fps DOUBLE, frame_count BIGINT, width INT, height INT, "
    "file_size BIGINT, frame_hashes ARRAY<STRING>, average_hash STRING"
)
EDGE_ROW = "src STRING, dst STRING, similarity DOUBLE"
GROUP_ROW = "group_id INT, leader STRING, path STRING, similarity DOUBLE, rank INT"
#: Columns of the exported records: one hash kind and the frame hashes are internal.
IMAGE_EXPORT = ["path", "width", "height", "file_size", "format", "mode", "phash", "ahash", "dhash"]
VIDEO_EXPORT = ["path", "duration", "fps", "frame_count", "width", "height", "file_size", "average_hash"]
