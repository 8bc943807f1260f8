"""Schemas of the records that the jobs read. Missing keys are null; sentinel values become null on ingest."""

OUTPUT = (
    "struct<run: int, text: string, gen_latency_s: double, total_latency_s: double, latency_s: double, input_len: int, gen_len: int, "
    "tokens_per_sec: double, tokens_per_second: double, error: string, embedding: array<float>, text_embedding: array<float>, entity_recall: double, "
    "count_accuracy: struct<n_categories_mentioned: int, n_categories_correct: int, n_categories_present: int, count_exact_accuracy: double, count_mae: double>, "
    "caption_similarity_max: double, caption_similarity_mean: double, clipscore_cos: double, clipscore: double>"
)
HW_STATS = (
    "struct<power_watts_avg: double, power_watts_peak: double, power_rails: map<string, double>, energy_joules_est: double, gpu_mem_alloc_gb_peak: double, "
    "cpu_percent_avg: double, duration_seconds: double, sample_count: int, source: string>"
)
RUN = (
    "model string, model_name string, model_tag string, model_key string, device string, device_name string, host string, dtype string, image_id string, "
    "image_path string, image_name string, image_width int, image_height int, task string, task_prompt string, task_purpose string, "
    f"outputs array<{OUTPUT}>, hw_stats {HW_STATS}, expected_entities array<string>, expected_counts map<string, int>, timestamp string, run_group string"
)
DEPLOYMENT = (
    "image_index int, image_name string, image_path string, image_width int, image_height int, image_resolution string, task string, task_purpose string, "
    "task_prompt string, latency_ms double, latencies_ms array<double>, images_per_second double, prompt_tokens int, response_tokens_est int, n_tiles int, "
    "output_text string, error string, power_stats struct<method: string, power_rails: map<string, struct<avg: double, peak: double, min: double>>, "
    "power_watts_avg: double, energy_joules_est: double, sample_count: int, duration_seconds: double>, timestamp string, run_group string"
)
ANNOTATIONS = "categories array<struct<id: int, name: string>>, annotations array<struct<image_id: bigint, category_id: int, caption: string>>"
TESTSET = "image_id bigint, file_name string, full_path string, expected_entities array<string>"
JUDGED = (
    "image string, model string, caption string, detections array<struct<class: string, conf: double, xyxy: array<double>>>, hallucination double, grounding double, "
    "violations array<struct<type: string, claim: string, claim_raw: string, claim_normalized: string, claim_count: int>>, claims array<string>, "
    "detected_classes array<string>"
)
MOVEMENT = (
    "Date string, Time string, Direction string, X_start double, X_end double, `CPU%` double, `GPU%` double, RAM_used_MB double, RAM_total_MB double, "
    "CPU_temp_C double, GPU_temp_C double"
)
FILTER_METRICS = "timestamp string, filter string, frame_index string, fps string, cpu_percent string, memory_percent string, gpu_percent string"
