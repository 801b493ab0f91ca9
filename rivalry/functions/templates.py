"""Prompt rendering: zip turns and format them with a template.

Turns are zipped to the *shortest* of the three lists (Python ``zip``), then
each turn is rendered by a Column lambda and the blocks are concatenated —
all inside one ``transform`` so the work stays in whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rivalry.functions.lists import strip_ws

# ---------------------------------------------------------------------------
# Template texts that must equal the reference output exactly.
# ---------------------------------------------------------------------------
INSTRUCTION_BLOCK = ("Instruction:\n", "\n\nResponse A:\n", "\n\nResponse B:\n", "\n\n")
FIRST_TURN_TAGS = ("<prompt>:", " <response_a>:", " <response_b>:", " ")
HASH_BLOCK = ("\n###Instruction:: ", " \n###Response A: ", " \n###Response B: ", "")
FLAT_TAGS = ("<prompt>: ", "\n\n<response_a>: ", "\n\n<response_b>: ")
USER_PROMPT_LAYOUT = ("User prompt: ", "\n\nModel A :\n", "\n\n--------\n\nModel B:\n")
RESULT_SUFFIX = "[RESULT]:"
CHATBOT_HEADER = ("Which one of the chatbots below did a better job responding to the user "
                  "request? Or were they tied?")
HASH_HEADER = (
    "Please analyze the conversation below between a human and two language models which "
    "give both respectively give the response ###Response A and ###Response B. The models "
    "are each asked to respond to the same prompts which is indicated by ###Instruction:. \n"
    "After reviewing the responses from both models, please determine which is the better "
    "response overall - Response_a, Response_b, or was it a tie? Respond with only a single "
    "word after [RESULT]: . Either \"A\" if ###Response A was better, \"B\" if ###Response B "
    "was better, or \"tie\" if their responses were equally good or bad")
CONTEXT_HEADER = (
    "Please analyze the conversation below between a human and two language models which "
    "give both respectively give the response ###Response A and ###Response B. The models "
    "are each asked to respond to the same prompts which is indicated by ###Instruction:. \n"
    "After reviewing the responses from both models, please determine which is the  better "
    "responses overall - Response_a, Response_b, or was it a tie? Respond with only a single "
    "word after [RESULT]: . Either \"A\" if ###Response A was better, \"B\" if ###Response B "
    "was better, or \"tie\" if their responses were equally good or bad\n"
    "You might be also provided a somewhat similar response and prompt from a sample "
    "database. While these might not be fully relevant or accurate, they might provide some "
    "context to the conversation about what is the best response and how it should ideally "
    "look like. If given , it would be packed inside a \n"
    "<Sample Response><prompt>prompt inside</prompt><response>Ideal response</response>"
    "</Sample Response> tag.")
CONTEXT_BLOCK = ("\n<Sample Response><prompt>", "</prompt>\n<response>", "</response></Sample Response>")
LABEL_SHORT = {0: "A", 1: "B", 2: "tie"}
LABEL_SENTENCE = {0: "A is better", 1: "B is better", 2: "Both are equal"}
# Chat templates (public model formats); content is stripped like the Jinja ``trim`` filter.
CHAT_TEMPLATES = {
    "gemma": {"bos": "<bos>", "prefix": "<start_of_turn>", "sep": "\n", "suffix": "<end_of_turn>\n",
              "roles": {"user": "user", "assistant": "model", "system": "user"},
              "generation": "<start_of_turn>model\n"},
    "llama3": {"bos": "<|begin_of_text|>", "prefix": "<|start_header_id|>",
               "sep": "<|end_header_id|>\n\n", "suffix": "<|eot_id|>",
               "roles": {"user": "user", "assistant": "assistant", "system": "system"},
               "generation": "<|start_header_id|>assistant<|end_header_id|>\n\n"},
}
# Judge-rationale prompt (T16), placeholders in braces.
JUDGE_TEMPLATE = '''
You are an expert language model analyst. Your task is to compare two responses to a given prompt and explain in detail why one is better than the other. Provide a comprehensive analysis based on the following criteria:

1. Relevance (Score 1-10):
   - How well does each response address the original prompt?
   - Are all parts of the prompt adequately covered?

2. Coherence (Score 1-10):
   - Is the response well-structured with a clear flow of ideas?
   - Are there logical transitions between sentences and paragraphs?

3. Clarity (Score 1-10):
   - How easy is it to understand the main points of each response?
   - Is the language used appropriate for the target audience?

4. Depth (Score 1-10):
   - Does the response provide sufficient detail and examples?
   - Are complex ideas thoroughly explained?

5. Accuracy (Score 1-10):
   - Is the information provided factually correct?
   - Are there any misleading or outdated statements?

6. Tone (Score 1-10):
   - Is the tone appropriate for the context of the prompt?
   - Does it maintain a consistent voice throughout?

7. Creativity (Score 1-10):
   - Does the response offer unique insights or perspectives?
   - Is there original thinking demonstrated?

8. Conciseness (Score 1-10):
   - Is the response appropriately concise without omitting important details?
   - Is there unnecessary repetition or verbosity?

Original Prompt:
{original_prompt}

Response A:
{response_a}

Response B:
{response_b}

Better Response: {better_response}

Analysis:
1. Provide a detailed explanation of why the chosen response is better, referencing each of the criteria mentioned above.
2. For each criterion, explain why one response scored higher than the other.
3. Highlight any particular strengths of the better response.
4. Identify specific areas where the other response could be improved.
5. If applicable, mention any unique aspects or approaches in either response that are noteworthy.
6. Whenever you mention a critique or suggestion, quote the text from the responses to support your analysis.

Scoring Summary:
- Response A Scores: [Provide scores for each criterion]
- Response B Scores: [Provide scores for each criterion]
- Total Score A: [Sum of A's scores]
- Total Score B: [Sum of B's scores]

Conclusion:
Summarize in 2-3 sentences why the chosen response is superior overall.
'''

# Paraphrase request prompt (T17), placeholders in braces.
PARAPHRASE_TEMPLATE = """Paraphrase the following conversation, considering the provided label throughout the process. Maintain the essence, overall structure, and tone of each response while using significantly different wording and examples.

{conversation}

Label: {label}

Guidelines for paraphrasing:

1. Preserve the core message and main points of each response.
2. Adjust the content subtly to align with the given label, emphasizing strengths or weaknesses as appropriate.
3. Use fresh examples, analogies, or phrasing that convey similar ideas to the original.
4. Maintain any unique elements like humor, formality, or technical detail characteristic of each response.
5. Ensure the paraphrased version reads naturally and captures the original tone and style.
6. If the label indicates a tie, balance the quality and appeal of both responses equally.
7. The responses should be packed in the following <prompt></prompt>, <response_a></response_a>, <response_b></response_b> format. Inside them should be the paraphrase text. Keep in mind each new conversation inside the original conversation should have its own conversation

Your paraphrased version should feel like a natural conversation that accurately represents the original while subtly reflecting the label's assessment."""

SYSTEM_MESSAGE = "You are a helpful assistant."
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_turns(p, a, b) -> Column:
    """Number of zipped turns = shortest list (NULL list counts as empty)."""
    return F.least(*[F.coalesce(F.size(_c(x)), F.lit(0)) for x in (p, a, b)]).cast("int")


def render_turns(p, a, b, block: Callable[[Column, Column, Column], Column]) -> Column:
    """Concatenate ``block(prompt_i, a_i, b_i)`` over the zipped turns."""
    p, a, b = _c(p), _c(a), _c(b)
    idx = F.array_repeat(F.lit(0), F.greatest(n_turns(p, a, b), F.lit(0)))
    return F.array_join(F.transform(idx, lambda _x, i: block(F.get(p, i), F.get(a, i), F.get(b, i))), "")


def _fmt(parts):
    def block(p, a, b):
        return F.concat(F.lit(parts[0]), p, F.lit(parts[1]), a, F.lit(parts[2]), b, F.lit(parts[3]))
    return block


def render_instruction_blocks(p, a, b) -> Column:
    """T4: ``Instruction:`` / ``Response A:`` / ``Response B:`` blocks for every turn."""
    return render_turns(p, a, b, _fmt(INSTRUCTION_BLOCK))


def render_first_turn(p, a, b) -> Column:
    """T5: only the first zipped turn, inline tags; '' when there is no turn."""
    p, a, b = _c(p), _c(a), _c(b)
    blk = _fmt(FIRST_TURN_TAGS)
    return F.when(n_turns(p, a, b) > 0, blk(F.get(p, 0), F.get(a, 0), F.get(b, 0))).otherwise(F.lit(""))


def render_hash_blocks(p, a, b, header: str = HASH_HEADER, result_suffix: bool = False) -> Column:
    """Header followed by ``###Instruction::`` blocks (+ ``[RESULT]:`` at scoring time)."""
    body = F.concat(F.lit(header), render_turns(p, a, b, _fmt(HASH_BLOCK)))
    return F.concat(body, F.lit(RESULT_SUFFIX)) if result_suffix else body


def render_flat_tags(prompt, resp_a, resp_b) -> Column:
    """``<prompt>: … <response_a>: … <response_b>: …`` over already-joined text."""
    return F.concat(F.lit(FLAT_TAGS[0]), _c(prompt), F.lit(FLAT_TAGS[1]), _c(resp_a),
                    F.lit(FLAT_TAGS[2]), _c(resp_b))


def render_user_prompt(prompt, resp_a, resp_b) -> Column:
    """T8: "User prompt / Model A / Model B" layout."""
    return F.concat(F.lit(USER_PROMPT_LAYOUT[0]), _c(prompt), F.lit(USER_PROMPT_LAYOUT[1]), _c(resp_a),
                    F.lit(USER_PROMPT_LAYOUT[2]), _c(resp_b))


def label_text(label, mapping: dict | None = None) -> Column:
    """Label → text through a literal map (``element_at`` on ``create_map``)."""
    mapping = mapping or LABEL_SHORT
    m = F.create_map(*[x for k, v in sorted(mapping.items()) for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, _c(label))


def chat_template(messages, template: str = "gemma", add_generation_prompt: bool = False) -> Column:
    """``array<struct<role,content>>`` → role-tagged string."""
    t = CHAT_TEMPLATES[template]
    roles = F.create_map(*[x for k, v in t["roles"].items() for x in (F.lit(k), F.lit(v))])
    body = F.array_join(F.transform(_c(messages), lambda m: F.concat(
        F.lit(t["prefix"]), F.coalesce(F.element_at(roles, m["role"]), m["role"]), F.lit(t["sep"]),
        strip_ws(m["content"]), F.lit(t["suffix"]))), "")
    out = F.concat(F.lit(t["bos"]), body)
    return F.concat(out, F.lit(t["generation"])) if add_generation_prompt else out


def user_message(content) -> Column:
    """A one-message conversation ``[{role: user, content}]``."""
    return F.array(F.struct(F.lit("user").alias("role"), _c(content).alias("content")))


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split ``template`` into ('lit', text) / ('var', name) pieces on ``{name}``."""
    import re
    out, pos = [], 0
    for m in re.finditer(r"\{([a-z_]+)\}", template):
        out.append(("lit", template[pos:m.start()]))
        out.append(("var", m.group(1)))
        pos = m.end()
    out.append(("lit", template[pos:]))
    return [p for p in out if p != ("lit", "")]


def fill_template(template: str, **values) -> Column:
    """``str.format`` as a ``concat`` of literals and columns (NULL column → NULL)."""
    return F.concat(*[F.lit(v) if k == "lit" else _c(values[v]) for k, v in template_parts(template)])
