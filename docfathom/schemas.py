"""Schemas of the engine's entities."""

from __future__ import annotations

CHUNK = (
    "id string, contentHash string, postId string, postTitle string, postUrl string, sourcePath string, profile string, profileSource string, "
    "parentId string, headingPath array<string>, sectionTitle string, sectionAnchor string, chunkIndex int, childOrdinal int, sectionOccurrence int, "
    "chunkType string, tokenCount int, tokenizerVersion string, overflowReason string, content string, retrievalText string, blockTypes array<string>, "
    "sourceLines struct<start:int,end:int>, resourceLinks array<string>, tags array<string>, categories array<string>, metadataOnly boolean"
)
POST = "id string, title string, url string, sourcePath string, slug string, date string, published boolean, draft boolean, tags array<string>, categories array<string>, profile string, profileSource string, content string, bodyLine int"
CODE_BLOCK = (
    "id string, anchor string, postId string, postTitle string, postUrl string, sectionTitle string, headingPath array<string>, ordinal int, language string, "
    "code string, sourceLineStart int, sourceLineEnd int, contextChunkIds array<string>, contentHash string"
)
VECTOR = "id string, contentHash string, fingerprint string, values array<double>"
LINK = "sourcePostId string, sourceUrl string, targetPostId string, targetUrl string, targetSourcePath string, label string, anchor string, resolved boolean"
CLAIM = "id string, subquestionId string, text string, quote string, citationIds array<string>"
FEEDBACK = "receiptId string, receivedAt timestamp, rating string, reason string, route string, evidenceStatus string, verificationStatus string, citationChunkIds array<string>, answerDigest string"
