"""Schemas of the stored tables, as DDL text that every Spark reader takes. Keys are longs, figures doubles, times timestamps in UTC."""

from __future__ import annotations

MODELS = ("model_id bigint, name string, description string, source string, status string, created_at timestamp, updated_at timestamp")
MODEL_VERSIONS = (
    "version_id bigint, model_id bigint, version string, description string, deployment_date timestamp,"
    " previous_version_id bigint, metadata string, weights_path string, is_current boolean, created_at timestamp"
)
PROMPTS = (
    "prompt_id bigint, model_version_id bigint, input_text string, output_text string, tokens array<string>,"
    " token_probabilities string, logits array<double>, generation_trace string, embeddings array<array<double>>,"
    " input_length int, output_length int, generation_time_ms double, cpu_time_ms double, gpu_time_ms double,"
    " temperature double, top_k int, top_p double, max_new_tokens int, submitted_at timestamp, processed_at timestamp"
)
PROMPT_METRICS = (
    "prompt_id bigint, entropy double, kl_divergence double, js_divergence double, wasserstein_distance double,"
    " ngram_drift double, embedding_drift double, token_frequency map<string,double>,"
    " token_distribution_by_position array<struct<position:int,token:string,is_new:boolean,is_rare:boolean>>,"
    " rare_token_percentage double, new_token_percentage double, median_length double, length_variance double,"
    " baseline_metadata string, is_anomaly boolean, anomaly_reasons array<string>, calculated_at timestamp"
)
PROMPT_SETS = ("prompt_set_id bigint, name string, description string, source_filename string, created_at timestamp")
PROMPT_SET_ITEMS = ("prompt_set_id bigint, position bigint, input_text string, metadata map<string,string>")
EVALUATION_JOBS = (
    "job_id bigint, prompt_set_id bigint, model_version_id bigint, reference_version_id bigint, status string,"
    " error_message string, generation_params string, total_prompts int, processed_prompts int,"
    " successful_prompts int, failed_prompts int, created_at timestamp, started_at timestamp, completed_at timestamp"
)
EVALUATION_ITEMS = (
    "item_id bigint, job_id bigint, model_version_id bigint, input_text string, output_text string,"
    " tokens array<string>, probabilities array<double>, generation_time_ms double, status string, error_message string"
)
BENCHMARK_JOBS = (
    "job_id bigint, model_version_id bigint, status string, error_message string, dataset_id string, sample_count int,"
    " max_new_tokens int, temperature double, num_beams int, max_tokens int, top_k int, rare_percentile double,"
    " seed bigint, result string, snapshot_id bigint, created_at timestamp, started_at timestamp, completed_at timestamp"
)
SNAPSHOTS = (
    "snapshot_id bigint, model_version_id bigint, period_start timestamp, period_end timestamp, total_prompts bigint,"
    " avg_entropy double, avg_kl_divergence double, avg_generation_time double, avg_output_length double,"
    " anomaly_count bigint, anomaly_percentage double, benchmark map<string,double>, metrics_data string,"
    " calculated_at timestamp"
)
THRESHOLDS = (
    "threshold_id bigint, name string, metric_name string, threshold_value double, comparison_operator string,"
    " is_active boolean, persistence_count int, persistence_window_minutes int, group_key string,"
    " require_all_in_group boolean, description string"
)
RULES = ("rule_id bigint, name string, operator string, is_active boolean, description string")
RULE_ITEMS = (
    "rule_item_id bigint, rule_id bigint, metric_name string, threshold_value double, comparison_operator string,"
    " persistence_count int, persistence_window_minutes int"
)
NOTIFICATIONS = (
    "notification_id bigint, model_version_id bigint, prompt_id bigint, alert_threshold_id bigint, title string,"
    " message string, severity string, status string, recipients array<string>, acknowledged_at timestamp,"
    " acknowledged_by bigint, response_comment string, created_at timestamp"
)
COLLAPSE_EVENTS = (
    "event_id bigint, model_version_id bigint, prompt_id bigint, triggered_metrics string, baseline_metadata string,"
    " persistence_metadata string, created_at timestamp"
)
AUDIT_LOGS = (
    "audit_id bigint, user_id bigint, action string, entity_type string, entity_id bigint, old_value string,"
    " new_value string, ip_address string, user_agent string, timestamp timestamp"
)
USERS = ("user_id bigint, email string, username string, full_name string, role string, is_active boolean, created_at timestamp")
SYSTEM_SETTINGS = ("setting_id bigint, key string, value string, description string, updated_at timestamp")

#: Tables that a snapshot holds.
SNAPSHOT_TABLES = {
    "users": USERS,
    "models": MODELS,
    "model_versions": MODEL_VERSIONS,
    "prompts": PROMPTS,
    "prompt_metrics": PROMPT_METRICS,
    "aggregated_metrics": SNAPSHOTS,
    "alert_thresholds": THRESHOLDS,
    "alert_rules": RULES,
    "alert_rule_items": RULE_ITEMS,
    "notifications": NOTIFICATIONS,
    "audit_logs": AUDIT_LOGS,
    "system_settings": SYSTEM_SETTINGS,
    "collapse_events": COLLAPSE_EVENTS,
}
