"""Schemas of the stored tables."""

VIDEOS = "video_id string, path string, native_fps double, frame_count int, width int, height int"
FRAMES = "video_id string, sampled_index int, frame_idx int, timestamp_sec double, h int, w int, gray binary"
BASE_CELLS = "video_id string, gap int, t int, y int, x int, u float, v float, m float, p15 float, keep boolean"
FUSED_CELLS = "video_id string, t int, y int, x int, m float, u float, v float"
UNIT_CELLS = "video_id string, t int, y int, x int, mu float, uu float, uv float"
BLOCK_EVENTS = "video_id string, event_id int, y int, x int, t0 int, t1 int, duration int"
ROIS = "name string, x1 int, y1 int, x2 int, y2 int"
