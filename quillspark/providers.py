"""A model behind the usual chat-completions interface, as an extraction provider.

Nothing imports this module by default; it needs no package beyond Python's own.
"""
from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from .operators.extract import AuthenticationError, ProviderError


class RateLimited(ProviderError):
    """Too many calls; tried again after a wait."""


class BadRequest(ProviderError):
    """The service refused the request itself; the same one is not sent again."""

    retryable = False


def full_name(model: str, provider: str) -> str:
    """``provider/model`` unless the model names its provider."""
    return model if "/" in model else f"{provider}/{model}"


def message(prompt: str, images: list[str] | None) -> dict:
    """A user's message: plain text, or text and the images' data URLs."""
    if not images:
        return {"role": "user", "content": prompt}
    parts = [{"type": "text", "text": prompt}] if prompt else []
    return {"role": "user", "content": parts + [{"type": "image_url", "image_url": {"url": url}} for url in images]}


@dataclass
class ChatProvider:
    """``base_url`` is the service's root; the key comes from the environment variable
    ``key_variable`` on the executors unless it is given.  ``extra_body`` is added to
    every request."""

    base_url: str
    model: str
    instructions: str = ""
    api_key: str | None = None
    key_variable: str = "QUILLSPARK_API_KEY"
    supports_images: bool = False
    temperature: float | None = 0.0
    timeout: float = 120.0
    extra_body: dict = field(default_factory=dict)

    def request(self, prompt: str, images: list[str] | None) -> dict:
        said = [{"role": "system", "content": self.instructions}] if self.instructions else []
        body = {"model": self.model, "messages": [*said, message(prompt, images)]}
        if self.temperature is not None:
            body["temperature"] = self.temperature
        return body | self.extra_body

    def complete(self, prompt: str, images: list[str] | None = None) -> tuple[str, int, int]:
        key = self.api_key or os.environ.get(self.key_variable)
        if not key:
            raise AuthenticationError(f"no key: set {self.key_variable}")
        data = json.dumps(self.request(prompt, images)).encode()
        call = urllib.request.Request(f"{self.base_url.rstrip('/')}/chat/completions", data, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as reply:
                told = json.load(reply)
        except urllib.error.HTTPError as e:
            kind = {401: AuthenticationError, 403: AuthenticationError, 429: RateLimited, 408: ProviderError}.get(e.code, BadRequest if e.code < 500 else ProviderError)
            raise kind(f"the service answered {e.code}") from e
        except (OSError, ValueError) as e:
            raise ProviderError(f"the call failed: {type(e).__name__}") from e
        try:
            text = told["choices"][0]["message"]["content"]
        except (KeyError, IndexError, TypeError) as e:
            raise ProviderError("the answer has no message") from e
        if isinstance(text, list):  # parts of a message
            text = "".join(p.get("text", "") for p in text if isinstance(p, dict))
        if not text:
            raise ProviderError("the answer is empty")
        used = told.get("usage") or {}
        return text, int(used.get("prompt_tokens") or 0), int(used.get("completion_tokens") or 0)
