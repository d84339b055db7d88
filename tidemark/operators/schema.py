"""Row types. An absent side is a null struct; an ``mtime`` of 0 and a ``hash`` of "" mean unknown."""

CHECKSUM = "struct<algo:string,value:string>"
ENTITY = f"path string, is_directory boolean, size bigint, mtime bigint, hash string, remote_checksum {CHECKSUM}, backend_meta map<string,string>"
BASELINE = f"path string, hash string, local_mtime bigint, remote_mtime bigint, local_size bigint, remote_size bigint, remote_checksum {CHECKSUM}, backend_meta map<string,string>, synced_at bigint"
RENAME_PAIR = "old_path string, new_path string, is_folder boolean"
HISTORY = "seq bigint, path string, action string, duplicate_path string, has_markers boolean, at bigint"

ENTITY_FIELDS = ("path", "is_directory", "size", "mtime", "hash", "remote_checksum", "backend_meta")
BASELINE_FIELDS = ("path", "hash", "local_mtime", "remote_mtime", "local_size", "remote_size", "remote_checksum", "backend_meta", "synced_at")

#: Checksum algorithms, the last of which no client can compute.
ALGORITHMS = ("md5", "sha1", "sha256", "dropbox", "quickxor", "opaque")
ACTIONS = ("push", "pull", "match", "conflict", "delete_local", "delete_remote", "cleanup", "rename_local", "rename_remote")
