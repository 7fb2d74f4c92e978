"""Model providers over HTTP: three public request shapes behind the Provider protocol.

Addresses, model names and the environment variables that hold the keys come
from the configuration; keys are read on the executor that asks, and are not
part of any plan. A transport takes (url, headers, body) and returns the decoded
JSON answer, so tests need no network.
"""

from __future__ import annotations

import base64
import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

Transport = Callable[[str, dict[str, str], dict], dict]


#: Media types of file endings.
MEDIA_TYPES = {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}


def post(url: str, headers: dict[str, str], body: dict) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=120) as answer:
        return json.load(answer)


def media_type(name: str) -> str:
    """By the file's ending; what is not known counts as JPEG."""
    return MEDIA_TYPES.get(name.rsplit(".", 1)[-1].lower(), "image/jpeg")


@dataclass
class Config:
    """Where and whom to ask."""

    name: str
    url: str
    model: str
    key_variable: str
    most_tokens: int = 1000

    def key(self) -> str:
        found = os.environ.get(self.key_variable)
        if not found:
            raise RuntimeError(f"{self.key_variable} is not set")
        return found


class HttpProvider:
    def __init__(self, config: Config, transport: Transport = post):
        self.name, self.config, self.transport = config.name, config, transport

    def headers(self) -> dict[str, str]:
        return {"authorization": f"Bearer {self.config.key()}"}

    def body(self, prompt: str, files: list[str], images: list[bytes]) -> dict:
        raise NotImplementedError

    def text(self, answer: dict) -> str:
        raise NotImplementedError

    def ask(self, prompt: str, files: list[str], images: list[bytes]) -> str:
        return self.text(self.transport(self.config.url, self.headers(), self.body(prompt, files, images))) or ""


class ChatProvider(HttpProvider):
    """The prompt as a system message, then a user message for every image, as a JPEG data address."""

    def body(self, prompt, files, images):
        pictures = [{"type": "image_url", "image_url": {"url": "data:image/jpeg;base64," + base64.b64encode(i).decode()}} for i in images]
        asked = [{"role": "user", "content": [{"type": "text", "text": f}, p]} for f, p in zip(files, pictures)]
        return {"model": self.config.model, "messages": [{"role": "system", "content": prompt}, *asked]}

    def text(self, answer):
        return answer["choices"][0]["message"]["content"]


class MessagesProvider(HttpProvider):
    """One user message with all images, each with its own media type, and the prompt; answers are of limited length."""

    def headers(self):
        return {"x-api-key": self.config.key()}

    def body(self, prompt, files, images):
        pictures = [
            {"type": "image", "source": {"type": "base64", "media_type": media_type(f), "data": base64.b64encode(i).decode()}} for f, i in zip(files, images)
        ]
        content = [*pictures, {"type": "text", "text": prompt}]
        return {"model": self.config.model, "max_tokens": self.config.most_tokens, "messages": [{"role": "user", "content": content}]}

    def text(self, answer):
        return "".join(part.get("text", "") for part in answer["content"])


class ContentsProvider(HttpProvider):
    """A list of contents: the prompt, then every image inline."""

    def headers(self):
        return {"x-goog-api-key": self.config.key()}

    def body(self, prompt, files, images):
        pictures = [{"inline_data": {"mime_type": media_type(f), "data": base64.b64encode(i).decode()}} for f, i in zip(files, images)]
        return {"contents": [{"parts": [{"text": prompt}, *pictures]}]}

    def text(self, answer):
        return "".join(part.get("text", "") for part in answer["candidates"][0]["content"]["parts"])
