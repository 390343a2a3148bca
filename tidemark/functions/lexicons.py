"""Words that analyses of a feed about language models go by; all operators take others as parameters."""

from __future__ import annotations

# Phrases, in order, and the token that each becomes.
COMPOUNDS = [
    (r"chain[\s\-_]+of[\s\-_]+thought", "chain_of_thought"),
    (r"tree[\s\-_]+of[\s\-_]+thought", "tree_of_thought"),
    (r"retrieval[\s\-_]+augmented[\s\-_]+generation", "rag"),
    (r"retrieval[\s\-_]augmented", "rag"),
    (r"in[\s\-_]+context[\s\-_]+learning", "in_context_learning"),
    (r"reinforcement[\s\-_]+learning[\s\-_]+from[\s\-_]+human[\s\-_]+feedback", "rlhf"),
    (r"direct[\s\-_]+preference[\s\-_]+optim\w*", "dpo"),
    (r"proximal[\s\-_]+policy[\s\-_]+optim\w*", "ppo"),
    (r"group[\s\-_]+relative[\s\-_]+policy[\s\-_]+optim\w*", "grpo"),
    (r"supervised[\s\-_]+fine[\s\-_]?tun\w*", "sft"),
    (r"instruction[\s\-_]+tun\w*", "instruction_tuning"),
    (r"parameter[\s\-_]+efficient[\s\-_]+fine[\s\-_]?tun\w*", "peft"),
    (r"low[\s\-_]+rank[\s\-_]+adapt\w*", "lora"),
    (r"mixture[\s\-_]+of[\s\-_]+expert\w*", "moe"),
    (r"speculative[\s\-_]+decod\w*", "speculative_decoding"),
    (r"continuous[\s\-_]+batching", "continuous_batching"),
    (r"paged[\s\-_]+attention", "paged_attention"),
    (r"flash[\s\-_]+attention", "flash_attention"),
    (r"kv[\s\-_]+cache", "kv_cache"),
    (r"key[\s\-_]+value[\s\-_]+cache", "kv_cache"),
    (r"context[\s\-_]+window", "context_window"),
    (r"long[\s\-_]+context", "long_context"),
    (r"function[\s\-_]+calling", "function_calling"),
    (r"tool[\s\-_]+use", "tool_use"),
    (r"multi[\s\-_]+agent", "multi_agent"),
    (r"agentic[\s\-_]+ai", "agentic_ai"),
    (r"language[\s\-_]+agent\w*", "language_agent"),
    (r"vision[\s\-_]+language[\s\-_]+model\w*", "vlm"),
    (r"large[\s\-_]+vision[\s\-_]+model\w*", "lvm"),
    (r"multimodal[\s\-_]+llm\w*", "multimodal_llm"),
    (r"large[\s\-_]+language[\s\-_]+model\w*", "llm"),
    (r"language[\s\-_]+model\w*", "llm"),
    (r"foundation[\s\-_]+model\w*", "foundation_model"),
    (r"pre[\s\-_]?train\w*[\s\-_]+model\w*", "pretrained_model"),
    (r"text[\s\-_]+to[\s\-_]+image", "text_to_image"),
    (r"text[\s\-_]+to[\s\-_]+video", "text_to_video"),
    (r"vector[\s\-_]+database\w*", "vector_database"),
    (r"dense[\s\-_]+retrieval", "dense_retrieval"),
    (r"cross[\s\-_]+encoder", "cross_encoder"),
    (r"bi[\s\-_]+encoder", "bi_encoder"),
    (r"token[\s\-_]+budget", "token_budget"),
    (r"model[\s\-_]+compress\w*", "model_compression"),
    (r"weight[\s\-_]+quanti[sz]\w*", "weight_quantization"),
    (r"post[\s\-_]+training[\s\-_]+quanti[sz]\w*", "ptq"),
    (r"quantization[\s\-_]+aware[\s\-_]+training", "qat"),
    (r"knowledge[\s\-_]+distill\w*", "knowledge_distillation"),
    (r"neural[\s\-_]+scaling[\s\-_]+law\w*", "scaling_laws"),
    (r"scaling[\s\-_]+law\w*", "scaling_laws"),
    (r"emergent[\s\-_]+abilit\w*", "emergent_abilities"),
    (r"hallucin\w+", "hallucination"),
    (r"world[\s\-_]+model\w*", "world_model"),
    (r"reward[\s\-_]+model\w*", "reward_model"),
    (r"constitutional[\s\-_]+ai", "constitutional_ai"),
    (r"human[\s\-_]+alignment", "alignment"),
]

# Tokens and the concept that each counts as.
CONCEPTS = {
    "llms": "llm", "agents": "agent", "transformers": "transformer", "embeddings": "embedding", "tokens": "token", "datasets": "dataset", "benchmarks": "benchmark", "hallucinations": "hallucination",
    "attentions": "attention", "parameters": "parameter", "prompts": "prompt", "prompting": "prompt", "finetune": "fine_tuning", "finetuning": "fine_tuning", "fine-tuning": "fine_tuning", "fine-tune": "fine_tuning",
    "reasoning": "reasoning", "reasonings": "reasoning", "aligning": "alignment", "aligned": "alignment", "evaluations": "evaluation", "evaluating": "evaluation", "pre-training": "pretraining", "pretrains": "pretraining",
    "qlora": "lora", "llama": "llama", "chatgpt": "chatgpt", "gpt-4": "gpt4", "gpt4": "gpt4", "gpt-3": "gpt3",
}

# Tokens that make a topic worth a card.
ANCHORS = [
    "llm", "agent", "rag", "inference", "reasoning",
    "tool_use", "function_calling", "multi_agent", "language_agent", "agentic_ai",
    "kv_cache", "speculative_decoding", "continuous_batching", "paged_attention", "flash_attention", "weight_quantization", "ptq", "qat", "model_compression",
    "rlhf", "dpo", "ppo", "grpo", "sft", "instruction_tuning", "lora", "moe", "reward_model", "constitutional_ai", "alignment",
    "vlm", "lvm", "multimodal_llm", "text_to_image", "text_to_video",
    "vector_database", "dense_retrieval", "cross_encoder", "bi_encoder", "embedding",
    "scaling_laws", "long_context", "context_window",
]
