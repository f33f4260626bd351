"""recengine.functions"""
