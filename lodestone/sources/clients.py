"""Clients for hosted models. `post` is replaceable, so that tests need no network: post(url, headers, body, seconds) -> (status, text)."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from lodestone.config import Settings

# The services' addresses.
CHAT_URL = "https://api.groq.com/openai/v1/chat/completions"
EMBEDDING_URL = "https://api-inference.huggingface.co/models/{model}"

Post = Callable[[str, dict, dict, float], tuple[int, str]]


class ClientError(RuntimeError):
    """A service is not configured, refuses, or answers in an unexpected form."""


def http_post(url: str, headers: dict, body: dict, seconds: float) -> tuple[int, str]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def _ask(post: Post, url: str, key: str, body: dict, seconds: float):
    status, text = post(url, {"Authorization": f"Bearer {key}"}, body, seconds)
    if status != 200:
        raise ClientError(f"the service answered {status}: {text}")
    try:
        return json.loads(text)
    except ValueError as e:
        raise ClientError("the service's answer is no JSON") from e


@dataclass(frozen=True)
class ChatClient:
    api_key: str | None = field(default_factory=lambda: Settings().llm_api_key)
    model: str = field(default_factory=lambda: Settings().llm_model)
    post: Post = http_post

    def __post_init__(self):
        if not self.api_key:
            raise ClientError("no key for the language model: set LLM_API_KEY")

    def complete(self, prompt: str) -> str:
        data = _ask(self.post, CHAT_URL, self.api_key, {"model": self.model, "messages": [{"role": "user", "content": prompt}]}, 60.0)
        try:
            return data["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ClientError("an answer of unexpected form") from e


@dataclass(frozen=True)
class EmbeddingClient:
    api_key: str | None = field(default_factory=lambda: Settings().embedding_api_key)
    model: str = field(default_factory=lambda: Settings().embedding_model)
    post: Post = http_post

    def __post_init__(self):
        if not self.api_key:
            raise ClientError("no key for the embedding model: set EMBEDDING_API_KEY")

    def embed(self, text: str) -> list[float]:
        """The text's vector; vectors per token are averaged."""
        data = _ask(self.post, EMBEDDING_URL.format(model=self.model), self.api_key, {"inputs": text, "options": {"wait_for_model": True}}, 30.0)
        if isinstance(data, list) and data and all(isinstance(x, (int, float)) for x in data):
            return [float(x) for x in data]
        if isinstance(data, list) and data and all(isinstance(x, list) for x in data):
            return [sum(column) / len(data) for column in zip(*data, strict=True)]
        raise ClientError("an answer of unexpected form")
