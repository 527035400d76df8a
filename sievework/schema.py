"""Schemas of the record table and its side relations; absent keys read as null."""

from __future__ import annotations

FACE_BOX = "struct<x:int,y:int,w:int,h:int>"
COMPONENTS = "struct<aesthetic:double,emotion:double,memorability:double,rot:double,prominence:double,candid_bonus:boolean,closed_eyes_penalty:boolean,soft_blur_penalty:boolean,distraction_penalty:boolean>"

FILTERED = "path string, blur_score double, blur_tier string, exposure_mean double, phash string, cluster_id int, is_cluster_best boolean, status string"
ENRICHED = (
    "capture_time timestamp_ntz, moment_id int, moment_label string, moment_start timestamp_ntz, moment_end timestamp_ntz, faces_detected int, "
    "persons_matched array<string>, is_group_photo boolean, shot_type array<string>, primary_shot_type string, max_smile_score double, "
    f"has_closed_eyes boolean, confusion_warning boolean, face_bboxes array<{FACE_BOX}>, clip_event_tags array<string>"
)
BURSTS = "burst_group_id int, burst_pos_rank int, burst_llm_rank int"
SCORED = (
    "brisque_score double, laion_score double, laion_method string, nima_score double, nima_method string, musiq_score double, aesthetic_score double, "
    "rot_score double, prominence_score double, distraction_penalty double, emotion_score double, memorability_score double, llava_fallback boolean, "
    f"base_score double, final_score double, score_components {COMPONENTS}"
)
SELECTED = "selected boolean, selection_rank int, mmr_score double"
RECORD = ", ".join([FILTERED, ENRICHED, BURSTS, SCORED, SELECTED])

VECTORS = "path string, embedding array<float>"
PERSONS = "name string, embedding array<double>, sources array<string>"
PROMPTS = "idx int, label string, embedding array<float>"
SCAN_FILE = "path string, filename_lower string, folder_rel string, file_size bigint, width int, height int, pixels bigint"
SCAN_REPORT = (
    "version int, scan_folder string, generated string, total_files bigint, skip array<string>, keep array<string>, folder_counts map<string,bigint>, "
    "hash_dup_groups array<struct<entries:array<struct<path:string,folder:string,res:string,size_mb:double,decision:string>>>>"
)
REVIEW_EVENTS = "seq bigint, path string, action string, arg string"
REVIEWS = "path string, status string, person_tags array<string>"
