"""Built-in extractors, by file format."""

from graphloom.sources.extractors import adapters, graphql, javascript, markdown, openapi, operations, rust

EXTRACTORS = [*markdown.EXTRACTORS, *rust.EXTRACTORS, *javascript.EXTRACTORS, *openapi.EXTRACTORS, *graphql.EXTRACTORS, *operations.EXTRACTORS, *adapters.EXTRACTORS]
