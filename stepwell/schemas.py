"""Relations of the engine as Spark DDL."""

from __future__ import annotations

RAW_CHAT = "source_index bigint, chat string"
PREPARED = "task_id string, chain_length int, user_goal string, expected_tool_sequence array<string>, injected_error_at_step int, arguments string, arguments_style string, source_index bigint"
GENERAL_TEXT = "text string, source_index bigint, n_words bigint"
STEP = "struct<step_index: int, tool_name: string, succeeded: boolean, recovered_from_error: boolean, error: string, error_type: string, arguments_match: boolean>"
MESSAGE = "struct<role: string, content: string>"
TASK = "task_id string, chain_length int, user_goal string, expected_tool_sequence array<string>, injected_error_at_step int, expected_arguments array<string>"
RESULT = f"condition string, task_set string, chain_length int, task_id string, success boolean, num_steps_attempted int, injected_error_at_step int, failure_step_index int, failure_error_type string, steps array<{STEP}>, transcript array<{MESSAGE}>"
RESULT_EXTRAS = "seed int, n_tools int, pair string, sweep string, model_key string, hf_id string, train_steps int, train_n_examples int, train_loss_summary struct<n_logged: int, sft_first: double, sft_last: double, kd_first: double, kd_last: double, nonfinite: int>"
DIVERGENCE = "source_layer int, target_layer int, stream string, input_set string, cka double, cosine_distance double, condition string"
LOSS_LOG = "step int, epoch int, sft_loss double, kd_loss double, total_loss double, learning_rate double"
BFCL_QUESTION = "id string, question array<array<struct<role: string, content: string>>>, function array<struct<name: string, description: string, parameters: string>>"
BFCL_ANSWER = "id string, ground_truth array<string>"
DEFAULT_TASK_SET = "unseen_tools"
