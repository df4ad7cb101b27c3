"""Readers and writers of row sets, documents, vectors and reports."""

from sievekit.sources.readers import npy_vectors, numbered_lines, read_any, read_csv, read_index, read_json_tasks, read_jsonl, read_jsonl_strict, read_npy, read_parquet, result_files, seed_runs, tex_table, trajectories
from sievekit.sources.writers import append_new, checkpointed, exists, manifest, upsert_manifest, write_csv, write_index, write_json, write_jsonl, write_npy, write_result_files, write_tex

__all__ = [
    "append_new", "checkpointed", "exists", "manifest", "npy_vectors", "numbered_lines", "read_any", "read_csv", "read_index", "read_json_tasks", "read_jsonl", "read_jsonl_strict", "read_npy", "read_parquet", "result_files", "seed_runs", "tex_table", "trajectories", "upsert_manifest", "write_csv", "write_index", "write_json", "write_jsonl", "write_npy", "write_result_files", "write_tex",
]
