"""The modules of this subpackage that have queries: one for each operator, and the pipeline."""

MODULES = ("packing", "substring_dedup", "quality_rules", "license_scan", "token_ids", "language_id", "simhash", "sharding", "decontamination", "quality_classifier", "mixing", "fill_in_middle", "conversation_repair", "pipeline")
