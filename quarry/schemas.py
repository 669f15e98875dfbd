"""Table schemas of the record store, the graph and the code corpus."""

from pyspark.sql.types import StructType

_ = StructType.fromDDL

MEMORIES = _(
    "id string, content string, embedding array<float>, memory_type string, user_id string, agent_id string, run_id string, namespace string, metadata string,"
    "event_time timestamp, ingestion_time timestamp, valid_from timestamp, valid_until timestamp, importance_score double, access_count long,"
    "last_accessed_at timestamp, invalidation_reason string, superseded_by string, content_hash string, embedding_state string"
)
ENTITIES = _("id string, name string, entity_type string, description string, embedding array<float>, content_hash string, user_id string, created_at timestamp")
RELATIONS = _(
    "id string, src string, dst string, relation_type string, relation_class string, provenance string, confidence_class string, freshness_generation long,"
    "staleness_state string, weight double, valid_from timestamp, valid_until timestamp"
)
CODE_CHUNKS = _(
    "id string, file_path string, content string, language string, start_line int, end_line int, chunk_type string, name string, context_path string,"
    "embedding array<float>, content_hash string, project_id string, generation long, indexed_at timestamp"
)
CODE_SYMBOLS = _("id string, name string, symbol_type string, file_path string, start_line int, end_line int, project_id string, signature string, embedding array<float>, generation long, indexed_at timestamp")
SYMBOL_RELATION = _(
    "src string, dst string, relation_type string, relation_class string, provenance string, confidence_class string, freshness_generation long,"
    "staleness_state string, project_id string, file_path string, line_number int, created_at timestamp"
)
SYMBOL_CHUNK_MAP = _("project_id string, symbol_id string, chunk_id string, overlap_score double, generation long")
FILE_MANIFEST = _("project_id string, file_path string, content_hash string, size long, updated_at timestamp")
INDEX_JOBS = _("job_id string, project_id string, state string, phase string, generation long, updated_at timestamp, detail string")
FILE_CHECKPOINTS = _("project_id string, generation long, file_path string, content_hash string, completed boolean, updated_at timestamp")
ACTIVE_GENERATIONS = _("project_id string, capability string, generation long")
EMBEDDING_CACHE = _("content_hash string, vector array<float>")
