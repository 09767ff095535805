"""Operators on DataFrames: conversion, extraction, clustering, matching and verification."""
