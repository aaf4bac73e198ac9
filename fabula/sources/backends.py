"""Language-model back ends: anything with ``complete(system, user, schema) -> dict``, made by name.

A back end that gives no answer, or one that is no JSON object with the schema's required keys, raises RuntimeError.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterable


def checked(text: str | None, schema: dict) -> dict:
    if not text:
        raise RuntimeError("the model gave an empty answer")
    try:
        found = json.loads(text)
    except ValueError as e:
        raise RuntimeError("the model's answer is no JSON") from e
    missing = [k for k in schema.get("required", ()) if not isinstance(found, dict) or k not in found]
    if missing or not isinstance(found, dict):
        raise RuntimeError(f"the model's answer does not follow the schema: {missing or type(found).__name__}")
    return found


class Scripted:
    """Recorded answers, in order or by prompt: for tests and for replays."""

    def __init__(self, answers: Iterable | Callable):
        self.answers = answers if callable(answers) else iter(answers)
        self.asked: list[tuple[str, str]] = []

    def complete(self, system: str, user: str, schema: dict) -> dict:
        self.asked.append((system, user))
        found = self.answers(system, user) if callable(self.answers) else next(self.answers, None)
        return checked(found if isinstance(found, str) or found is None else json.dumps(found), schema)


class ChatServer:
    """A server with the chat completions interface and JSON schema answers."""

    def __init__(self, model: str | None = None, base_url: str | None = None, temperature: float | None = None, timeout: float = 600):
        self.model, self.temperature, self.timeout = model, temperature, timeout
        self.url = (base_url or os.environ.get("OPENAI_BASE_URL") or "https://api.openai.com/v1").rstrip("/") + "/chat/completions"

    def request(self, system: str, user: str, schema: dict) -> dict:
        body = {"model": self.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "response_format": {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}}
        return body | ({} if self.temperature is None else {"temperature": self.temperature})

    def complete(self, system: str, user: str, schema: dict) -> dict:
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get('OPENAI_API_KEY', 'none')}"}
        asked = urllib.request.Request(self.url, json.dumps(self.request(system, user, schema)).encode(), head)
        with urllib.request.urlopen(asked, timeout=self.timeout) as answer:
            found = json.load(answer)
        return checked((found.get("choices") or [{}])[0].get("message", {}).get("content"), schema)


class MessagesClient:
    """The messages interface, through its public client library, with the schema as a tool that must be used."""

    def __init__(self, model: str | None = None):
        try:
            import anthropic
        except ImportError as e:
            raise RuntimeError("this back end needs its client library") from e
        self.client, self.model = anthropic.Anthropic(), model

    def complete(self, system: str, user: str, schema: dict) -> dict:
        tool = {"name": "answer", "description": "The answer.", "input_schema": schema}
        reply = self.client.messages.create(model=self.model, max_tokens=16_000, system=system, messages=[{"role": "user", "content": user}], tools=[tool], tool_choice={"type": "tool", "name": "answer"})
        return checked(next((json.dumps(b.input) for b in reply.content if b.type == "tool_use"), None), schema)


def make_backend(provider: str, model: str | None = None, base_url: str | None = None, temperature: float | None = None):
    if provider == "openai":
        return ChatServer(model, base_url, temperature)
    if provider == "anthropic":
        if temperature is not None:
            raise ValueError("this back end takes no temperature")
        return MessagesClient(model)
    raise ValueError(f"unknown provider: {provider!r}")
